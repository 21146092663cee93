"""TF-IDF search reads its documents once, on all cores, and returns what comparing all pairs returns."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tablewright.operators.retrieval import tfidf_search


def _brute(docs, queries, top_k):
    def terms(text):
        return Counter(re.findall(r"\w{2,}", text.lower()))

    tf = {d: terms(t) for d, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
    norm = {d: math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items())) for d, c in tf.items()}
    found = set()
    for q, text in queries:
        own = {w: n * idf[w] for w, n in terms(text).items() if w in idf}
        size = math.sqrt(sum(x * x for x in own.values()))
        words = set(text.lower().split())
        scores = []
        for d, body in docs:
            score = sum(x * tf[d][w] * idf[w] for w, x in own.items()) / (size * norm[d]) if own and norm[d] else 0.0
            score += 0.4 * len(words & set(body.lower().split())) / (len(words) + 1)
            if score > 0.05:
                scores.append((-round(score, 12), d))
        found |= {(q, d, round(-s, 6), place + 1) for place, (s, d) in enumerate(sorted(scores)[:top_k])}
    return found


def test_search_reads_documents_once_and_equals_brute_force(spark, tmp_path):
    docs = [(i, f"w{i % 7} common a-b w{i % 11} {'alone' + str(i) if i % 3 else ''} Tail{i % 2}") for i in range(60)] + [(60, ""), (61, "zz zz zz")]
    queries = [(1, "common w3 tail1"), (2, "alone5 common"), (3, "nowhere"), (4, "zz w5 w5 a-b"), (5, "")]
    spark.createDataFrame(docs, "doc long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    asked = spark.createDataFrame(queries, "item long, text string")
    found = tfidf_search(spark.read.parquet(str(tmp_path / "docs")), "doc", "text", asked, "item", "text", 3, block_rows=16)
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]
    assert {tuple(r) for r in found.select("item", "doc", F.round("score", 6), "rank").collect()} == _brute(docs, queries, 3)
