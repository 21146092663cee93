"""One query for each operator of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.contamination import find_contamination
from tablewright.llm.importance import resample
from tablewright.llm.licenses import scan_licenses
from tablewright.llm.lines import judge_lines
from tablewright.llm.middle import fill_in_middle, restored
from tablewright.llm.near import near_components
from tablewright.llm.oracles import ORACLES
from tablewright.llm.packing import pack
from tablewright.llm.quality import rate
from tablewright.llm.scoring import score
from tablewright.llm.substrings import remove_repeats
from tablewright.llm.tokenfiles import read_token_files, with_crc, write_token_files
from tablewright.llm.toxicity import find_toxic
from tablewright.llm.warc import page_id, read_records, write_archives
from tablewright.session import shared_folder


__all__ = ["ORACLES", "QUERIES", "tokenizer"]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words left in every document after removal of repeated runs of 35 words."""
    kept = remove_repeats(_read(spark, folder, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with words of every document, and those that an equal or similar earlier line removes."""
    docs = _read(spark, folder, "documents")
    lines = judge_lines(docs, percent=80)
    gone = F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line_no"))))
    counts = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("removed").alias("n_removed"), F.array_join(gone, ",").alias("removed_lines"))
    counts = counts.withColumnRenamed("doc_id", "id")
    found = docs.select("doc_id").distinct().join(counts, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return found.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed_lines", F.lit("")).alias("removed_lines"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in every document."""
    return scan_licenses(_read(spark, folder, "documents"))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, written and read back: place, length and checksum of every document."""
    path = f"{shared_folder(spark)}/tokens/{uuid4().hex}"
    write_token_files(_read(spark, folder, "documents"), path, tokenizer("byte_bpe_50k.json"), end_id=2)
    return with_crc(read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids"))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside 13-word windows of benchmark items, and the verdict at one word in twenty."""
    found = find_contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"), window=13, share=(1, 20))
    names = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), names, "contaminated")


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Context-tree and unigram scores of all documents, learnt from six sevenths of them."""
    docs = _read(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 7 == 2
    scored = score(docs.select("doc_id", "text", held_out.alias("held_out")), "held_out")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose four-word shingle sets are similar to 0.8."""
    return near_components(_read(spark, folder, "documents"), size=4, percent=80)


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document; documents labelled good are the trusted ones."""
    return rate(_read(spark, folder, "documents"), _read(spark, folder, "labels").where("quality = 1"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of 2**k tokens, 2048 at most, from all documents."""
    packed = pack(_read(spark, folder, "documents"), None, tokenizer("word_bpe_49k.json"), end_id=1, longest=2048)
    return with_crc(packed.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Chain of classifiers learnt from the labels, applied to every document."""
    return find_toxic(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the documents, drawn by their likeness to the benchmark's words."""
    drawn = resample(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"), share=(10, 100), least_words=20, longest=1, buckets=10_000, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Form, parts and checksums of every document's fill-in-the-middle text, and of the text rebuilt from it."""
    made = fill_in_middle(_read(spark, folder, "documents"), percent=100, suffix_first=50, seed=7)
    sums = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return restored(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sums)


def op13_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as WARC records into ZIP-packaged archives and read back by ranges."""
    pages = _read(spark, folder, "pages")
    archives = write_archives(pages, f"{shared_folder(spark)}/archives/{uuid4().hex}", least_bytes=1000)
    found = read_records(archives, payloads=False).where("record_type in ('response', 'revisit')")
    kind = pages.schema["page_id"].dataType.simpleString()
    return found.select(page_id(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id(F.col("refers_to"), kind).alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_line_dedup,
        op3_license_scan,
        op4_token_files,
        op5_benchmark_decontamination,
        op6_lm_scoring,
        op7_minhash_near_dedup,
        op8_quality_rules,
        op9_packing,
        op10_toxicity,
        op11_importance_resampling,
        op12_fill_in_middle,
        op13_warc_archives,
    )
}
