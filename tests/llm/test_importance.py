import hashlib
import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tablewright.llm import crc, importance  # noqa: E402
from tablewright.llm.importance import resample  # noqa: E402


def runs(text, longest):
    w = brute.PLAIN.findall(brute.lower(text))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def expected(rows, target, share, least_words, longest, buckets, seed):
    def bucket(x):
        return zlib.crc32(x.encode()) % buckets

    ours, theirs = Counter(bucket(x) for _, t in rows for x in runs(t, longest)[1]), Counter(bucket(x) for t in target for x in runs(t, longest)[1])
    n, m = sum(ours.values()) + buckets, sum(theirs.values()) + buckets
    out = []
    for d, t in rows:
        words, own = runs(t, longest)
        gains = [math.floor(1000 * math.log((theirs[bucket(x)] + 1) * n / ((ours[bucket(x)] + 1) * m))) for x in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    can = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(can[: share[0] * len(can) // share[1]]):
        r[5] = k + 1
    return out


def test_crc_of_spans():
    draw = np.random.default_rng(1)
    data = draw.integers(0, 256, 300_000).astype(np.uint8)
    starts = np.sort(draw.integers(0, 200_000, 3000))
    ends = starts + draw.integers(0, 3 * crc.REACH, 3000)
    ends[:6] = starts[:6] + [0, 1, crc.REACH, crc.REACH + 1, 16 * crc.REACH, 100_000]
    assert crc.crc32_of_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert len(crc.crc32_of_spans(data, starts[:0], ends[:0])) == 0


@pytest.mark.parametrize("longest", [1, 3])
def test_drawn_documents(spark, docs, rows, longest):
    target = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()] + [None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "n_words long, text string")
    for share, least, buckets, seed in (((10, 100), 20, 10_000, 2024), ((1, 3), 0, 50, 7)):
        got = resample(docs, items, share, least, longest, buckets, seed).collect()
        want = expected(rows, target, share, least, longest, buckets, seed)
        # rows of one id and score take their places in any order
        assert sorted(map(str, got_rows(got))) == sorted(map(str, map(tuple, want)))


def got_rows(rows):
    return [tuple(r[c] for c in ("doc_id", *importance.NAMES)) for r in rows]


def test_long_words_and_slices(spark, monkeypatch):
    monkeypatch.setattr(importance, "SLICE_BYTES", 500)
    draw = random.Random(4)
    rows = [(i, " ".join("x" * draw.choice([1, 5, 63, 64, 65, 700, 5000]) + str(draw.randrange(9)) for _ in range(30))) for i in range(20)]
    rows.append((99, "ß" * 1_500_000 + " tail"))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    target = table.where("doc_id < 3")
    want = expected(rows, [t for _, t in rows[:3]], (1, 2), 2, 2, 1000, 1)
    assert sorted(map(str, got_rows(resample(table, target, (1, 2), 2, 2, 1000, 1).collect()))) == sorted(map(str, map(tuple, want)))


def test_one_id_for_most_rows_is_dealt_to_many_tasks(spark):
    rows = spark.range(4000).selectExpr("cast(null as bigint) as doc_id", "'a b c' as text").repartition(4)
    got = resample(rows, rows.limit(1), (1, 1), 1).select("rank").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 4001))


def test_nothing_to_draw(spark, docs):
    assert resample(docs.limit(0), docs).count() == 0
    empty = resample(docs, docs.limit(0))
    assert empty.count() == docs.count()
    assert resample(docs.where("text is null"), docs).where("rank is not null or weight <> 0").count() == 0
    with pytest.raises(ValueError):
        resample(docs.withColumnRenamed("doc_id", "rank"), docs, id_col="rank")
