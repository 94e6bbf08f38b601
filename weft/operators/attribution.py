"""Shapley attributions of tree ensembles, from their node tables.

A leaf asks some features of a row (its path's tests, merged by feature). With a feature unknown, the leaf is reached in
the share of training rows that pass its tests. The Shapley value of a feature is then a sum over the subsets of the
leaf's other features, weighted by their sizes. The sums by size are the coefficients of a product of one factor
(share + inside * x) a feature: factors are multiplied in one by one, and each feature's own is divided out again, so that
a leaf of k features takes k squared steps instead of two to the k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaf_boxes(nodes: list[dict]) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """(value, {feature: (lo, hi, share)}) of each leaf of a tree: lo < x <= hi, and the share of rows that pass."""
    return [(value, box) for _, value, box in numbered_boxes(nodes)]


def numbered_boxes(nodes: list[dict]) -> list[tuple[int, float, dict[int, tuple[float, float, float]]]]:
    """leaf_boxes() with each leaf's node number first."""
    by = {r["node"]: r for r in nodes}

    def walk(node: int, box: dict[int, tuple[float, float, float]]) -> Iterator[tuple[int, float, dict]]:
        r = by[node]
        if r["feature"] is None:
            yield node, r["value"], box
            return
        f, t = r["feature"], r["threshold"]
        lo, hi, share = box.get(f, (-math.inf, math.inf, 1.0))
        for child, new in ((2 * node, (lo, min(hi, t))), (2 * node + 1, (max(lo, t), hi))):
            if child in by:
                yield from walk(child, box | {f: (*new, share * by[child]["n"] / r["n"])})

    return list(walk(1, {}))


def leaf_shap(x: np.ndarray, value: float, box: dict[int, tuple[float, float, float]]) -> dict[int, np.ndarray]:
    """Attributions of rows (n, features) by one leaf: for each feature of its path."""
    own, n = sorted(box), len(x)
    k = len(own)
    inside = {f: (x[:, f] > box[f][0]) & (x[:, f] <= box[f][1]) for f in own}
    whole = np.zeros((k + 1, n))
    whole[0] = 1
    for f in own:
        # times share + inside * x
        whole[1:] = whole[1:] * box[f][2] + whole[:-1] * inside[f]
        whole[0] *= box[f][2]
    weight = [math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)]
    out = {}
    for f in own:
        share, on, total, higher = box[f][2], inside[f], np.zeros(n), np.zeros(n)
        for s in range(k - 1, -1, -1):
            # over share + x the quotient comes from the highest coefficient down; over share alone by division
            higher = np.where(on, whole[s + 1] - share * higher, whole[s] / share)
            total += weight[s] * higher
        out[f] = value * total * (on - share)
    return out


def tree_shap(x: np.ndarray, nodes: list[dict]) -> np.ndarray:
    """Attributions of rows (n, features) by one tree; the last column is the mean prediction."""
    n, m = x.shape
    out = np.zeros((n, m + 1))
    for value, box in leaf_boxes(nodes):
        out[:, m] += value * math.prod(b[2] for b in box.values())
        for f, phi in leaf_shap(x, value, box).items():
            out[:, f] += phi
    return out


def brute_shap(x: np.ndarray, nodes: list[dict]) -> np.ndarray:
    """The same by conditional expectations over all subsets of features, for checking."""
    by = {r["node"]: r for r in nodes}

    def expect(row: np.ndarray, known: set[int], node: int = 1) -> float:
        r = by[node]
        if r["feature"] is None:
            return r["value"]
        kids = [c for c in (2 * node, 2 * node + 1) if c in by]
        if r["feature"] in known:
            return expect(row, known, 2 * node if row[r["feature"]] <= r["threshold"] else 2 * node + 1)
        return sum(by[c]["n"] / r["n"] * expect(row, known, c) for c in kids)

    n, m = x.shape
    out = np.zeros((n, m + 1))
    for i, row in enumerate(x):
        out[i, m] = expect(row, set())
        for f in range(m):
            rest = [g for g in range(m) if g != f]
            for size in range(m):
                w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                for s in combinations(rest, size):
                    out[i, f] += w * (expect(row, {*s, f}) - expect(row, set(s)))
    return out


def shap_arrays(rows: DataFrame, nodes: DataFrame, features: int) -> DataFrame:
    """rows (x, ...) with phi: an array of each feature's attribution averaged over the trees, and the mean prediction last. The node table, of the model's size, is broadcast."""
    table: dict[int, list[dict]] = {}
    for r in nodes.select("tree", "node", "feature", "threshold", "n", F.col("mean").alias("value")).collect():
        table.setdefault(r.tree, []).append(r.asDict())
    shared = rows.sparkSession.sparkContext.broadcast(table)
    schema = rows.withColumn("phi", F.array(F.lit(0.0))).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
            phi = sum((tree_shap(x, t) for t in shared.value.values()), np.zeros((len(x), features + 1))) / max(1, len(shared.value))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (features + 1)), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    return rows.mapInArrow(work, schema)


def forest_shap(rows: DataFrame, nodes: DataFrame, key: str, features: int) -> DataFrame:
    """(key, feature, phi): attributions averaged over the trees; feature -1 is the mean prediction."""
    got = shap_arrays(rows.select(key, "x"), nodes, features).select(key, F.posexplode("phi").alias("feature", "phi"))
    return got.select(key, F.when(F.col("feature") < features, F.col("feature")).otherwise(-1).alias("feature"), "phi")


def leaf_contributions(rows: DataFrame, nodes: DataFrame, key: str, features: int) -> DataFrame:
    """(key, tree, leaf, feature, phi): what each leaf adds to the attribution of each feature on its path.

    The node table, of the model's size, is broadcast.
    """
    table: dict[int, list[dict]] = {}
    for r in nodes.select("tree", "node", "feature", "threshold", "n", F.col("mean").alias("value")).collect():
        table.setdefault(r.tree, []).append(r.asDict())
    shared = rows.sparkSession.sparkContext.broadcast(table)
    kind = rows.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
            n = len(x)
            for tree, own in shared.value.items():
                for leaf, value, box in numbered_boxes(own):
                    for f, phi in leaf_shap(x, value, box).items():
                        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, tree, np.int32)), pa.array(np.full(n, leaf, np.int64)), pa.array(np.full(n, f, np.int32)), pa.array(phi)], names=[key, "tree", "leaf", "feature", "phi"])

    return rows.select(key, "x").mapInArrow(work, f"{key} {kind}, tree int, leaf long, feature int, phi double")
