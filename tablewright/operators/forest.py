"""Isolation forest: trees grown on small keyed samples, one group per tree, scored by an Arrow UDF.

Every tree draws about TREE_ROWS rows of the whole table by key, so tree groups are bounded; scoring is a narrow pass over all rows with the trees broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.hashing import RANGE
from tablewright.operators.outliers import robust_scale
from tablewright.operators.quantiles import exact_quantiles

TREE_ROWS = 256
NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, path double"


def average_path(n: float) -> float:
    """Expected depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[list] = []
    waiting = [(points, 0, None, None)]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        index = len(nodes)
        if parent is not None:
            nodes[parent][side] = index
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(points.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + average_path(len(rows))])
            continue
        feature = int(rng.choice(usable))
        low = rows[:, feature].min()
        split = float(low + rng.random() * spread[feature])
        nodes.append([feature, split, -1, -1, 0.0])
        goes_left = rows[:, feature] <= split
        waiting.append((rows[~goes_left], depth + 1, index, 3))
        waiting.append((rows[goes_left], depth + 1, index, 2))
    return [tuple(n) for n in nodes]


def anomaly_flags(
    df: DataFrame, row_id: str, columns: list[str], contamination: float = 0.05, trees: int = 100, seed: int = 42
) -> DataFrame:
    """Add `anomaly_score` and `is_anomaly` (1 for the most isolated `contamination` share)."""
    if len(columns) < 2:
        return df.withColumns({"anomaly_score": F.lit(None).cast("double"), "is_anomaly": F.lit(0)})
    base = df.select(row_id, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    scaled = robust_scale(base, columns)
    total = base.count()
    # every tree draws its rows from the whole table
    rate = min(1.0, 1.3 * TREE_ROWS / max(1, total))
    member = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.shiftrightunsigned(F.xxhash64(F.lit(seed), t, F.col(row_id)), 4) < int(RANGE * rate))
    members = scaled.select(row_id, *columns, F.explode(member).alias("tree"))
    members = members.repartition(min(trees, 2 * df.sparkSession.sparkContext.defaultParallelism), "tree")
    limit = int(np.ceil(np.log2(TREE_ROWS)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 1000 + tree)
        points = pdf.sort_values(row_id)[columns].to_numpy(float)
        if len(points) > TREE_ROWS:
            points = points[rng.choice(len(points), TREE_ROWS, replace=False)]
        nodes = _grow(points, rng, limit)
        return pd.DataFrame([(tree, i, *n) for i, n in enumerate(nodes)], columns=["tree", "node", "feature", "split", "left", "right", "path"])

    nodes = members.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()  # at most trees × 511 nodes
    forest = [g.sort_values("node") for _, g in nodes.groupby("tree")]
    packed = [tuple(g[c].to_numpy() for c in ("feature", "split", "left", "right", "path")) for g in forest]
    shared = df.sparkSession.sparkContext.broadcast(packed)
    norm = average_path(min(TREE_ROWS, max(total, 2)))

    @F.pandas_udf(T.DoubleType())
    def score(*parts: pd.Series) -> pd.Series:
        points = np.column_stack([p.to_numpy(float) for p in parts])
        depth = np.zeros(len(points))
        for feature, split, left, right, path in shared.value:
            at = np.zeros(len(points), dtype=int)
            inner = feature[at] >= 0
            while inner.any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                goes_left = points[rows, feature[node]] <= split[node]
                at[rows] = np.where(goes_left, left[node], right[node])
                inner = feature[at] >= 0
            depth += path[at]
        return pd.Series(np.power(2.0, -depth / len(shared.value) / norm))

    scored = scaled.select(row_id, score(*columns).alias("anomaly_score"))
    cut = exact_quantiles(scored, {"anomaly_score": [1 - contamination]})["anomaly_score"][1 - contamination]
    flags = scored.withColumn("is_anomaly", (F.col("anomaly_score") > F.lit(cut)).cast("int"))
    return df.join(flags, row_id)
