"""Near-duplicate lookup against all pairs."""

import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from tablewright.operators.retrieval import DUPLICATE_COSINE, near_duplicate_queries
from tablewright.queries import ORACLES


def weights(rows):
    """By tenant: [(node, {word: weight})] and the counts of texts by word."""
    nodes = {}
    for query, tenant, text in rows:
        key = tenant, text.lower().strip()
        nodes[key] = min(nodes.get(key, query), query)
    made = {}
    for tenant in {t for t, _ in nodes}:
        own = sorted((node, Counter(re.findall(r"\w{2,}", body))) for (t, body), node in nodes.items() if t == tenant)
        df = Counter(w for _, c in own for w in c)
        made[tenant] = [(node, {w: n * (np.log((1 + len(own)) / (1 + df[w])) + 1) for w, n in c.items()}) for node, c in own], df
    return nodes, made


def prefix_pairs(rows):
    """Pairs that share a word in their prefixes, without regard to what is left on both sides."""
    pairs = set()
    for vectors, df in weights(rows)[1].values():
        held = {}
        for node, v in vectors:
            total, before = sum(x * x for x in v.values()), 0.0
            for w in sorted(v, key=lambda w: (df[w], w)):
                if 1 - before / total >= DUPLICATE_COSINE**2:
                    pairs |= {(other, node) for other in held.get(w, [])}
                    held.setdefault(w, []).append(node)
                before += v[w] ** 2
    return len(pairs)


def brute(rows):
    """{query: (match, score)} by the definition; rows of (query, tenant, text) with unique queries."""
    nodes, made = weights(rows)
    found = {}
    for vectors, _ in made.values():
        norms = {node: np.sqrt(sum(x * x for x in v.values())) for node, v in vectors}
        for i, (node, v) in enumerate(vectors):
            scores = [(-round(sum(x * u.get(w, 0) for w, x in v.items()) / norms[node] / norms[other], 9), other) for other, u in vectors[:i] if norms[node] and norms[other]]
            hits = [s for s in scores if -s[0] > DUPLICATE_COSINE]
            if hits:
                found[node] = min(hits)[1], -min(hits)[0]
    result = {}
    for query, tenant, text in rows:
        node = nodes[tenant, text.lower().strip()]
        if node != query:
            result[query] = node, 1.0
        elif node in found:
            result[query] = found[node]
    return result


def test_near_duplicates_equal_all_pairs_and_verify_few(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i:03d}" for i in range(400)]
    rows = []
    for i in range(400):
        # a rare word of ten texts each beside frequent ones: it is in all their prefixes
        rows.append([i, "ab"[i % 2], " ".join([f"rare{i % 40}", *rng.choice(words, 30)])])
    for i in range(400, 480):
        near = rows[int(rng.integers(0, 400))]
        text = near[2].split()
        text[5] = "w001"
        rows.append([i, near[1], " ".join(text) if i % 4 else near[2]])
    rows += [[480, "a", ""], [481, "a", " "], [482, "b", "x"]]
    met = []
    got = near_duplicate_queries(spark.createDataFrame(rows, "q long, t string, body string"), "q", "t", "body", met=met)
    want = brute(rows)
    assert {r["q"]: (r["match_id"], round(r["score"], 6)) for r in got.collect()} == {q: (m, round(s, 6)) for q, (m, s) in want.items()}
    # of the pairs that share a word of their prefixes, many can not reach the limit and are not verified
    assert 1.4 * met[0].count() < prefix_pairs(rows)


def test_near_duplicates_with_missing_values_and_repeated_ids(spark):
    rows = [(1, "a", "red green blue"), (1, "a", "red green blue"), (2, "a", "red green blue"), (None, "a", "red green blue"), (3, None, "red green blue"), (4, "a", None)]
    got = near_duplicate_queries(spark.createDataFrame(rows, "q long, t string, body string"), "q", "t", "body")
    assert sorted(map(tuple, got.collect())) == [(2, 1, 1.0)]


def near_copies(seed):
    """Texts that share rare words but little else, and groups of near copies."""
    rng = np.random.default_rng(seed)
    words = [f"w{i:03d}" for i in range(300)]
    texts = [" ".join([f"rare{i % 30}", f"odd{i % 25}", *rng.choice(words, 40)]) for i in range(300)]
    for i in range(120):
        text = texts[i % 6].split()
        text[int(rng.integers(5, 40))] = f"new{i}"
        texts.append(" ".join(text))
    return texts


def test_pairs_that_share_a_rare_word_alone_are_not_verified(spark):
    rows, met = [(i, "ab"[i % 2], text) for i, text in enumerate(near_copies(5))], []
    got = near_duplicate_queries(spark.createDataFrame(rows, "q long, t string, body string"), "q", "t", "body", met=met)
    assert {r["q"]: (r["match_id"], round(r["score"], 6)) for r in got.collect()} == {q: (m, round(s, 6)) for q, (m, s) in brute(rows).items()}
    alike = 0
    for vectors, _ in weights(rows)[1].values():
        unit = [{w: x / np.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for _, v in vectors]
        alike += sum(sum(x * u.get(w, 0) for w, x in v.items()) > 0.85 for i, v in enumerate(unit) for u in unit[:i])
    assert met[0].count() <= 1.2 * alike


def test_near_duplicates_in_small_blocks_and_groups_with_odd_rows_equal_sql(spark):
    texts = near_copies(6)
    rows = [(None if i % 17 == 0 else i // 2 if i % 13 == 0 else i, [None, "a", "b", "c"][min(i % 7, 3)], None if i % 23 == 0 else text) for i, text in enumerate(texts)]
    rows += [*rows[40:60], (9001, "a", ""), (9002, "b", " - "), (9003, "a", texts[0].upper() + "  ")]
    got = near_duplicate_queries(spark.createDataFrame(rows, "doc_id long, lang string, text string"), "doc_id", "lang", "text", block_terms=900, group_terms=400)
    with duckdb.connect() as con:
        con.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "lang": [r[1] for r in rows], "text": [r[2] for r in rows]}))
        want = con.sql(ORACLES["n3_near_duplicate_documents"]).fetchall()
    assert want and sorted((*r[:2], round(r[2], 6)) for r in got.collect()) == sorted(want)
