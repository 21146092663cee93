"""From raw documents to training sequences: five stages, each written before the next one reads it.

Every stage takes (spark, docs, sf_dir), docs holding what the stage before kept, and returns a DataFrame: the columns of
documents for all but the last, one row a sequence for the last.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.contamination import find_contamination
from tablewright.llm.lines import remove_lines
from tablewright.llm.near import near_components
from tablewright.llm.packing import pack
from tablewright.llm.quality import WHITE
from tablewright.llm.queries import tokenizer
from tablewright.llm.toxicity import given_categories, score_chain, train_chain
from tablewright.session import checkpointed, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _beside_text(docs: DataFrame) -> DataFrame:
    """All columns but the text as one value, and the text, so that an operator's verdict comes back with the very row it is about."""
    return docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"]).alias("__rest"), "text")


def _rows(judged: DataFrame, docs: DataFrame) -> DataFrame:
    return judged.select(*[F.col("text") if c == "text" else F.col(f"__rest.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key that is never NULL and orders as doc_id does: rows without an id are a document each, by a number that is written
    once; rows that share an id are one document only where their texts are equal too."""
    number = F.xxhash64("text")
    if docs.where("doc_id is null").head(1):
        docs = checkpointed(docs.withColumn("__number", F.monotonically_increasing_id()))
        number = F.when(F.col("doc_id").isNull(), F.col("__number")).otherwise(number)
    return docs.withColumn("__key", F.struct("doc_id", number.alias("number")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labels, does not call toxic go on. Every row has its own verdict."""
    categories = given_categories()
    models = train_chain(docs, _table(spark, sf_dir, "labels"), categories)
    return _rows(score_chain(_beside_text(docs), models, list(categories), id_col="__rest", with_text=True).where("not toxic"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or similar to earlier ones leave the texts, n_chars counts what is left. A document that had words and has none
    now stops here: earlier documents hold all of its lines. Texts without words from the start go on."""
    words = F.btrim(F.coalesce("text", F.lit("")), F.lit(WHITE)) != ""
    left = remove_lines(_keyed(docs).withColumn("__had_words", words), percent=80, id_col="__key").where(words | ~F.col("__had_words"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the one with the smallest id goes on, and all that are linked to none."""
    keyed = _keyed(docs)
    gone = near_components(keyed, size=5, percent=80, id_col="__key").where("not kept").select("__key").distinct()
    return keyed.join(gone, "__key", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one word in twenty or more inside 13-word windows of benchmark items stop here. Every row has its own verdict."""
    found = find_contamination(_beside_text(docs), _table(spark, sf_dir, "benchmark"), window=13, share=(1, 20), id_col="__rest", with_text=True)
    return _rows(found.where("not contaminated"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2**k ids, 2048 at most."""
    # small slices: workers still hold memory of the stages before
    return pack(docs, None, tokenizer("word_bpe_49k.json"), end_id=1, longest=2048, slice_bytes=2 << 20)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Classifier and tokenizer can not be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline/{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
