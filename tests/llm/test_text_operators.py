import inspect
import math
import random
import sys
import weakref
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tablewright.llm import contamination as contamination_module  # noqa: E402
from tablewright.llm import ctw, near, quality, tokenizing, toxicity  # noqa: E402
from tablewright.llm.contamination import find_contamination  # noqa: E402
from tablewright.llm.licenses import TEMPLATES, classes, scan_licenses  # noqa: E402
from tablewright.llm.lines import judge_lines, remove_lines  # noqa: E402
from tablewright.llm.scoring import score  # noqa: E402
from tablewright.llm.substrings import remove_repeats  # noqa: E402
from tablewright.llm.toxicity import find_toxic, score_chain, train_chain  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def made(rows):
    return sorted(map(tuple, rows), key=str)


def variants(count, words, changes, start, seed=1):
    """Copies of one text with some words replaced: a group of near copies."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(400)}" for _ in range(words)]
    out = []
    for i in range(count):
        own = list(base)
        for _ in range(draw.randint(0, changes)):
            own[draw.randrange(words)] = f"z{draw.randrange(9999)}"
        if i % 10 == 9:
            base[draw.randrange(words)] = f"y{i}"
        out.append((start + i, " ".join(own)))
    return out


@pytest.mark.parametrize("window", [3, 35])
def test_repeated_runs(docs, rows, window):
    got = remove_repeats(docs, window=window).collect()
    assert made((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == made(brute.repeats(rows, window))
    assert all(sum(s["length"] for s in r["repeats"]) == r["n_removed"] for r in got)


def test_lines(spark, docs, rows):
    more = [(i, t + "\n\nab cd ef") for i, t in variants(60, 40, 7, 7000)] + [(8000, "a b c d\na b c d e\nd c b a\n x")]
    table = docs.union(spark.createDataFrame([(i, t, 1, "k", b"b", "n") for i, t in more], docs.schema))
    got = {(brute.order(r["doc_id"]), r["line_no"], r["removed"]) for r in judge_lines(table).collect()}
    assert got == brute.lines(rows + more)
    left = remove_lines(table)
    assert left.columns == table.columns and left.count() == len(rows + more)
    gone = {(i, k) for i, k, removed in got if removed}
    for r in left.where("doc_id >= 7000 and doc_id < 9000").collect():
        text = dict(more)[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for k, x in enumerate(text) if (brute.order(r["doc_id"]), k) not in gone)


def test_licenses(spark):
    def words(text):
        return brute.PLAIN.findall(brute.lower(text))

    def shingles(w):
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    draw = random.Random(2)
    rows = [(None, None), (1, ""), (2, "the license"), (3, "Released UNDER the (MIT) license")]
    for i, (name, notice) in enumerate(sorted(TEMPLATES.items())):
        for k in range(6):
            around = [[f"v{draw.randrange(50)}" for _ in range(draw.randrange(200))] for _ in range(2)]
            own = words(notice)
            if k > 2 and len(own) > 12:
                own[draw.randrange(len(own))] = "changed"
            rows.append((100 + 10 * i + k, " ".join(around[0] + own + around[1])))
    want = []
    for d, text in rows:
        w, found = words(text), set()
        for kind in classes(TEMPLATES, 3, 0.8, 2, 1e-6):
            for start in range(0, max(len(w), 1), kind.step):
                inside = shingles(w[start : start + kind.window])
                found |= {n for n in kind.names if len(inside & shingles(words(TEMPLATES[n]))) >= 0.8 * len(shingles(words(TEMPLATES[n])))}
        want.append((d, sorted(found)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert made((r["doc_id"], r["licenses"]) for r in scan_licenses(table).collect()) == made(want)
    assert sum(bool(f) for _, f in want) > 50
    assert scan_licenses(table.limit(0)).count() == 0


@pytest.mark.parametrize("characters", [1 << 20, 1500])
def test_contamination(spark, docs, rows, monkeypatch, characters):
    monkeypatch.setattr(contamination_module, "SHARD_CHARS", characters)
    given = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    items = [*given, (901, "Und die"), (902, "x"), (903, None), (904, "..."), (905, given[3][1]), (None, "the " * 20)]
    more = [(5000, "und die x x"), (5001, given[5][1] + " more"), (5002, "w " * 400 + given[5][1])]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = find_contamination(table, spark.createDataFrame(items, "item_id long, text string"), cleaned=True).collect()
    want = brute.contamination(rows + more, [(i if i is not None else "", t) for i, t in items])
    assert made((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got) == made(want)
    assert all(len(brute.PLAIN.findall(brute.lower(r["cleaned"]))) == r["n_words"] - r["n_hit"] for r in got)


def test_contamination_without_items(spark, docs):
    assert find_contamination(docs, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0 or contaminated").count() == 0


def test_scores(spark, rows):
    small = [(i, t[:500] if t else t) for i, t in rows[:20] + rows[-10:]]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in small]
    table = spark.createDataFrame([(i, t, h or None) for (i, t), h in zip(small, held, strict=True)], "doc_id long, text string, h boolean")
    train = [t for (_, t), h in zip(small, held, strict=True) if not h]
    tokens = [[*brute.WORDS.findall(brute.lower(t)), None] for _, t in small]
    counts = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n, v = sum(counts.values()), len(counts)
    trees = brute.context_trees(train, [t for _, t in small], ctw.DEPTH)
    got = sorted(score(table, "h").collect(), key=lambda r: (str(r["doc_id"]), r["score"]))
    want = sorted(zip(small, held, tokens, trees, strict=True), key=lambda x: (str(x[0][0]), x[3]))
    for r, ((i, t), h, own, tree) in zip(got, want, strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, h, len(own), sum(counts[x] > 0 for x in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own), rel=1e-9)
        assert r["score"] == pytest.approx(tree, rel=1e-6)
        assert r["bits_per_byte"] == pytest.approx(-tree / math.log10(2) / (len((t or "").encode()) + 1), rel=1e-6)
    assert score(table.limit(0), "h").count() == 0
    assert score(table.where("h"), "h").where("train_tokens = 0").count() == sum(held)


def test_gram_order_with_many_symbols():
    import numpy as np

    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    values, entry, row = ctw.grams(data, np.array([0, 1000, 1000, 5000]))
    assert len(row) == 5003 and (np.diff(values.astype(object)) > 0).all() and entry.max() == len(values) - 1


@pytest.mark.parametrize("size", [4, 5])
def test_near_components(spark, docs, rows, size):
    more = [*variants(200, 150, 12, 6000), (6001, "another text with the number of one above"), (5001, "a b c"), (5002, "A b c"), (5003, "a b c d")]
    more += [(5004, rows[7][1]), (None, rows[7][1])]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = near.near_components(table, size=size).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = brute.near(rows + more, size)
    assert made(got) == made(want)
    assert sum(not k for *_, k in want) > 50


def test_near_components_of_nothing(docs):
    assert near.near_components(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near.near_components(docs, percent=70)


def test_signature_join_finds_all_pairs_within_its_distance():
    import numpy as np

    draw = np.random.default_rng(3)
    one = draw.integers(0, 1 << 16, (1000, near.PLACES)).astype(np.uint16)
    two = one.copy()
    for r in two:
        at = draw.choice(near.PLACES, 2 * near.GROUPS - 1, replace=False)
        r[at] ^= np.uint16(1)
    assert all(set(a) & set(b) for a, b in zip(near.keys(one).tolist(), near.keys(two).tolist(), strict=True))


def test_quality(spark, docs, rows):
    trusted = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1")
    more = [(5000, "a b c a b c a b c d"), (5001, "a b a b a b a"), (5002, "l1\nl1\n \nl2\nl1 # * $ % & | < >")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = quality.rate(table, trusted).collect()
    good = {r["doc_id"] for r in trusted.collect()}

    def features(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in brute.WORDS.findall(text or "")]
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:], strict=False)]
        signed = [x - (1 << 64) if x >> 63 else x for x in h + pairs]
        return [x % quality.BUCKETS for x in signed]

    raw, target = Counter(), Counter()
    for i, t in rows + more:
        raw.update(features(t))
        if i in good:
            target.update(features(t))
    total_raw, total_target = (sum(c.values()) + quality.BUCKETS for c in (raw, target))
    want = []
    for i, t in rows + more:
        f = features(t)
        ratio = sum(math.log((target[x] + 1) / total_target) - math.log((raw[x] + 1) / total_raw) for x in f) / len(f) if f else None
        counts = brute.quality_counts(t)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want.append((i, *counts, failed, not failed and ratio >= quality.LEAST, None if ratio is None else round(ratio, 8)))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert made((*(r[c] for c in columns), None if r["ratio"] is None else round(r["ratio"], 8)) for r in got) == made(want)
    assert quality.rate(table.limit(0), trusted).count() == 0


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    kinds = {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    models = train_chain(docs, labels.where(~held), kinds)
    judged = score_chain(docs, models, list(kinds)).withColumnRenamed("toxic", "says").join(labels.where(held), "doc_id")
    counts = {(r["toxic"], r["says"]): r["count"] for r in judged.groupBy("toxic", "says").count().collect()}
    # some labels of the given table call junk toxic that holds no such word, so not all can be found
    assert counts[1, True] / (counts[1, True] + counts.get((1, False), 0)) > 0.8
    assert counts.get((0, True), 0) / counts[0, False] < 0.01
    assert len(models[1]) == len(models[0]) + 1  # the second model also reads the first one's probability


def test_toxicity_takes_odd_rows(spark, docs, rows):
    labels = spark.createDataFrame([(None, 1, 1), (900_000, 0, 1), (900_001, None, None), (900_003, 0, 1), (900_003, 1, 0), (1, 1, 0), (-5, 1, 1)], "doc_id long, quality int, toxic int")
    got = find_toxic(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["p_toxic"] <= 1 and (r["n_words"] > 0 or not r["toxic"]) for r in got)
    assert find_toxic(docs, labels.limit(0)).where("toxic").count() == 0
    assert find_toxic(docs.limit(0), labels).count() == 0


def test_toxicity_sample_is_of_labelled_documents(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(["vile"] * (i % 2) + [f"w{draw.randrange(40)}" for _ in range(20)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = [(i, 1, i % 2) for i in range(60)]
    kinds = {"toxic": F.col("toxic") == 1}

    def trained(docs, labels, n=60):
        return train_chain(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), kinds, sample_rows=n)[0]

    want = trained(docs, known)
    assert (want[:-1] != 0).any()
    # labels of absent documents and labels that say nothing take no places
    assert abs(trained(docs, known + [(1000 + i, 1, 0) for i in range(5000)]) - want).max() < 1e-6
    assert abs(trained(docs, known + [(None, 1, 1), (3, 1, None)]) - want).max() < 1e-6
    # repeated documents and labels count once, one text an id
    assert abs(trained(docs.union(docs).union(docs.where("doc_id < 5")).repartition(4), known + known[:9]) - want).max() < 1e-6
    more = toxicity.training_rows(docs.union(docs.selectExpr("doc_id", "concat(text, ' more')")), spark.createDataFrame(known, "doc_id long, quality int, toxic int"), kinds, 25, 3, "doc_id", "text")
    assert more.count() == 25 == more.select("__id").distinct().count()
    assert inspect.signature(train_chain).parameters["sample_rows"].default == 20_000


def test_licenses_of_common_kinds_and_every_place(spark):
    gap = " ".join(f"v{k}" for k in range(300))
    rows = [
        (1, "Licensed under the MIT License.", {"mit-named"}),
        (2, "you can redistribute it under the terms of the GNU Lesser General Public License", {"lgpl"}),
        (3, "under the GNU Affero General Public License", {"agpl"}),
        (4, "This is free and unencumbered software released into the public domain.", {"unlicense"}),
        (5, "available under the Eclipse Public License", {"epl"}),
        (6, "SPDX-License-Identifier: BSD-2-Clause", {"bsd-2-clause-spdx"}),
        (7, TEMPLATES["isc"], {"isc"}),
        (8, "released under the GNU General Public License, version 2", {"gpl", "gpl-2.0"}),
        (9, "Released under the Foo License.", set()),
        (10, f"Released under the MIT License. {gap} Released under the MIT License.", {"mit", "mit-named"}),
    ]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert all(set(got[i]["licenses"]) == want for i, _, want in rows)
    places = [(m["start"], m["start"] + m["length"]) for m in got[10]["matches"] if m["license"] == "mit"]
    assert len(places) == 2 and places[0][0] == 0 and places[0][1] < 20 and places[1][0] <= 305 and places[1][1] == 310


def test_line_counts_of_a_document_without_id(spark, tmp_path):
    from tablewright.llm.queries import op2_line_dedup

    spark.createDataFrame([(None, "one two three\nfour five six\none two three"), (4, "four five six"), (5, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(None, 3, 1, "2"), (4, 1, 1, "0"), (5, 0, 0, "")}


def test_repeated_words_of_texts_of_any_length(spark):
    """Texts below and above the lengths at which runs are sorted in another way."""
    from tablewright.llm.quality import joined_hashes, repeated_words, words_of
    from tablewright.operators.frames import settle

    draw = random.Random(5)
    texts = [" ".join(str(draw.randrange(kinds)) for _ in range(n)) for n, kinds in [(0, 1), (2, 2), (40, 4), (5000, 25), (66_000, 60), (66_000, 100_000)]]

    def plain(text):
        w = text.split()
        runs = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = [False] * len(w)
        for i, run in enumerate(zip(w, w[1:], w[2:], strict=False)):
            if runs[run] > 1:
                hit[i : i + 3] = [True] * 3
        return sum(hit)

    rows = settle(spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", words_of(F.col("text")).alias("words")), ["words"])
    rows = settle(rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))), ["hashes"])
    rows = settle(rows.withColumn("grams", joined_hashes(F.col("hashes"), 3)), ["grams"])
    assert dict(rows.select("i", repeated_words(F.col("words"), F.col("grams"), 3)).collect()) == {i: plain(t) for i, t in enumerate(texts)}


def test_similar_lines_in_any_order(spark):
    """Only earlier lines remove: places of one document at one line number do not remove each other, white space of any kind
    parts words, long lines and template lines are judged as short ones."""
    draw = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    rows = [(None, "a\tb c\x0bd e\n\n \t"), (None, "a b c d f"), (3, " ".join(base))]
    for i in range(40):
        cut = draw.sample(base, 300 - draw.randrange(20, 90))
        rows.append((10 + i, " ".join(cut) + "\n" + " ".join([*(f"t{k}" for k in range(8)), f"own{i}", f"other{i}"])))
    rows += [(100, "e d c b a\nw1 w2 w3"), (100, "w1 w2 w3 w4\nw1 w2 w3 w4 w5"), (2, "k l m n o p q r s\nk l m n o p q r s t")]
    got = {(brute.order(r["doc_id"]), r["line_no"], r["removed"]) for r in judge_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.lines(rows)


def test_lines_of_nothing_and_without_python(spark):
    """Tables without rows or words, columns that carry the operator's own names, and a plan without Python."""
    names = "doc_id long, text string, a string, line string, first int, hashes int, n int"
    empty = spark.createDataFrame([], names)
    assert judge_lines(empty).count() == 0 and remove_lines(empty).columns == empty.columns and remove_lines(empty).count() == 0
    rows = spark.createDataFrame([(1, None, "a", "b", 1, 2, 3), (2, "", "a", "b", 1, 2, 3), (3, "x y\n \nx y", "a", "b", 1, 2, 3)], names)
    left = remove_lines(rows)
    assert {tuple(r) for r in left.collect()} == {(1, None, "a", "b", 1, 2, 3), (2, "", "a", "b", 1, 2, 3), (3, "x y\n ", "a", "b", 1, 2, 3)}
    assert "Python" not in left._jdf.queryExecution().toString() and "Arrow" not in left._jdf.queryExecution().toString()


def test_toxicity_training_keeps_one_number_a_pair():
    """Pieces hold the buckets and a count a row, not the row beside every bucket; models are those of the widened pairs."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 30, 400)
    sizes[[0, 7, 399]] = 0
    row, bucket = np.repeat(np.arange(400), sizes), rng.integers(0, 60, sizes.sum()).astype(np.int32)
    target = np.bincount(row, bucket < 6, 400) > 0
    targets = np.column_stack([np.where(rng.random(400) < 0.1, np.nan, target), target]).astype(float)
    edges = np.concatenate([[0], np.cumsum(sizes)])

    def pieces(*cuts):
        return [(a, sizes[a:b].astype(np.int32), bucket[edges[a] : edges[b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    cut = pieces(0, 1, 150, 399, 400)
    many, one = (toxicity.fit_chain(p, targets, np.arange(400) % 3, 3, 5) for p in (cut, pieces(0, 400)))
    assert sum(a.nbytes for _, *arrays in cut for a in arrays) <= 4 * (len(bucket) + 400)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(many, one, strict=True))
    said = toxicity.probability(one[0], [(row, bucket)], np.zeros((400, 0)), 400)
    assert said[target].mean() > said[~target].mean() + 0.3


def test_encoders_are_let_go():
    import public_tokenizers

    own = tokenizing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    own.encode(b"some words, and more")
    gone = weakref.ref(own.known)
    del own
    tokenizing.release_encoders()
    assert gone() is None and not tokenizing._LOADED
