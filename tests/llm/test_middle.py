import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tablewright.llm import middle
from tablewright.llm.middle import fill_in_middle, restored


def expected(d, text, percent=100, suffix_first=50, seed=7, marks=("<P>", "<S>", "<M>")):
    text, (p, s, m) = text or "", marks
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if not text or any(x in text for x in marks) or h[2] % 100 >= percent:
        return d, len(lines), "plain", None, None, text
    prefix, center, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < suffix_first:
        return d, len(lines), "spm", len(prefix), len(center), s + suffix + p + prefix + m + center
    return d, len(lines), "psm", len(prefix), len(center), p + prefix + s + suffix + m + center


def odd_lines():
    draw = random.Random(3)
    pieces = ["\n", "a", "é", "<", "S>", "<P", "한", "xyz ", "\n\n", "\r"]
    return [(10_000 + i, "".join(draw.choice(pieces) for _ in range(draw.randrange(12)))) for i in range(400)] + [(20_000, "a<P>b\nc"), (20_001, "<M>"), (20_002, "\n"), (20_002, "\n")]


@pytest.mark.parametrize("options", [{}, {"percent": 60, "suffix_first": 10, "seed": 3, "marks": ("[pre]", "{suf}", "\n!mid!")}])
def test_forms_and_the_way_back(spark, docs, rows, options):
    more = odd_lines()
    table = docs.union(spark.createDataFrame([(i, t, 1, "k", b"b", "n") for i, t in more], docs.schema))
    made = fill_in_middle(table, **options)
    marks = {k: v for k, v in options.items() if k == "marks"}
    got = restored(made, **marks).collect()
    want = [expected(i, t, **options) for i, t in rows + more]
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    assert sorted(r["restored"] for r in got) == sorted(t or "" for _, t in rows + more)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_core_in_small_pieces(monkeypatch):
    import numpy as np

    monkeypatch.setattr(middle, "PIECE_BYTES", 5)
    made = [t.encode() for _, t in odd_lines()]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int64)
    data = np.frombuffer(b"".join(made), np.uint8)
    draws = [np.random.default_rng(k).integers(0, 1 << 32, len(made)) for k in range(2)]
    _, first, second = middle.line_cuts(data, offsets, draws)
    marks = middle._checked(("<P>", "<S>", "<M>"))
    form = np.where(np.diff(offsets) > 0, np.arange(len(made)) % 3, 0)
    for mark in marks:
        form[middle.places(data, offsets, mark)[1]] = 0
    out, bounds = middle.arranged(data, offsets, first, second, form, marks)
    back, ends, bad = middle.gathered(out, bounds, form, marks)
    assert not bad.any() and back.tobytes() == data.tobytes() and ends.tolist() == offsets.tolist()


def test_very_long_text(spark):
    text = "".join(f"line {k} é\n" for k in range(400_000))  # over two slices
    got = restored(fill_in_middle(spark.createDataFrame([(1, text), (2, "x\ny")], "doc_id long, text string"))).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, (expected(1, text), expected(2, "x\ny"))))
    assert next(r["restored"] for r in got if r["doc_id"] == 1) == text


def test_outputs_that_were_not_made_here(spark):
    rows = [("psm", "<P>a<S>b<M>c"), ("psm", "<P>a<S>b"), ("psm", "<S>b<P>a<M>c"), ("spm", "<S>b<P>a<M>c"), ("psm", "<P>a<S>b<M>c<M>"), ("psm", "x<P>a<S>b<M>c"), ("odd", "a"), (None, "a"), ("plain", None), ("plain", "<P>"), ("spm", "<S><P><M>")]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "number int, form string, output string")
    got = [r["restored"] for r in restored(table).orderBy("number").collect()]
    assert got == ["acb", None, None, "acb", None, None, None, None, None, "<P>", ""]


def test_marks_and_empty_tables(docs):
    for marks in (("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "z"), ("", "a", "b"), ("abc", "b", "z")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, marks=marks)
    assert restored(fill_in_middle(docs.limit(0))).count() == 0
    assert fill_in_middle(docs.withColumn("output", F.lit(1))).where("form <> 'plain' and not output like '%<M>%'").count() == 0
