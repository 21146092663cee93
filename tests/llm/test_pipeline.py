import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, "/root/repo")
import brute  # noqa: E402

from tablewright.llm.toxicity import find_toxic  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of every stage, with the odd rows among the documents."""
    from conftest import ODD

    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(i, t, None, "odd", None) for i, t in ODD], docs.schema)
    docs, found = docs.union(odd), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(folder / str(k)))
        after = spark.read.parquet(str(folder / str(k)))
        found.append((name, docs, after))
        docs = after
    return found


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns


def test_line_dedup(steps):
    _, before, after = steps[1]
    removed = {(i, k) for i, k, gone in brute.lines(pairs(before)) if gone}
    want = []
    for i, t in pairs(before):
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (brute.order(i), k) not in removed)
        if brute.WORDS.search(left or "") or not brute.WORDS.search(t or ""):
            want.append((i, left))
    assert sorted(pairs(after), key=str) == sorted(want, key=str)


def test_near_dedup(steps):
    _, before, after = steps[2]
    rows = pairs(before)
    want = [r for r, (*_, kept) in zip(rows, brute.near(rows, 5), strict=True) if kept]
    assert sorted(pairs(after), key=str) == sorted(want, key=str)


def test_decontamination(spark, steps):
    _, before, after = steps[3]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    rows = pairs(before)
    bad = {i for i, *_, contaminated in brute.contamination(rows, items) if contaminated}
    assert sorted(pairs(after), key=str) == sorted((r for r in rows if r[0] not in bad), key=str)


def test_packing(steps):
    _, before, after = steps[4]
    got = after.collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in pairs(before)}
    assert all(r["length"] == len(r["ids"]) and r["length"] & (r["length"] - 1) == 0 for r in got)


def test_verdicts_reach_rows_without_and_with_repeated_ids(spark, tmp_path):
    """Toxic, contaminated and copied rows under NULL and under an id that other rows have."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("text").collect() if r["text"] and len(r["text"].split()) >= 13]
    bad_id = spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 1").select("doc_id")
    scores = find_toxic(given, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    bad = given.join(scores.where("toxic").select("doc_id"), "doc_id").join(bad_id, "doc_id").orderBy("doc_id").first()["text"]

    def plain(name, lines=3):
        return "\n".join(" ".join(f"{name}{line}w{k}" for k in range(12)) for line in range(lines))

    def after(stage, rows, name):
        table = spark.createDataFrame([(i, t, None, "odd", None) for i, t in rows], given.schema)
        table.repartition(3).write.parquet(str(tmp_path / name))
        out = stage(spark, given.union(spark.read.parquet(str(tmp_path / name))) if name == "toxic" else spark.read.parquet(str(tmp_path / name)), FOLDER)
        return sorted(((r["doc_id"], r["text"]) for r in out.where("source = 'odd'").collect()), key=str)

    clean = [(None, plain("n")), (7_000_001, plain("r"))]
    assert after(corpus_pipeline.toxicity, [*clean, (None, bad), (7_000_001, bad)], "toxic") == sorted(clean, key=str)
    assert after(corpus_pipeline.decontamination, [*clean, (None, items[0]), (7_000_001, items[0])], "items") == sorted(clean, key=str)
    # copies under no id and, of one text beside others, under a repeated one
    copies = [*clean, (None, plain("n")), (None, plain("r")), (7_000_001, plain("q")), (7_000_002, plain("q"))]
    once = [(None, plain("n")), (None, plain("r")), (7_000_001, plain("q"))]
    assert after(corpus_pipeline.near_dedup, copies, "near") == sorted(once, key=str)
    assert after(corpus_pipeline.line_dedup, copies, "lines") == sorted(once, key=str)
