"""Histogram gradient boosting as set-oriented passes: one histogram and one split query for each level of all trees.

A fitted model is a table of nodes (tree, node, feature, bin, value, is_leaf), node ids 1, 2n, 2n+1. Rows are routed by a
join on node; scores are written to shared storage after each tree, so that lineage stays short.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import binning
from weft.operators.storage import materialise


def six_places(x: Column) -> Column:
    """x to the nearest millionth, ties upwards: the same in every engine of IEEE doubles."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def binned_features(df: DataFrame, key: str, features: list[str], bins: int, strategy: str = "uniform") -> DataFrame:
    """(key, bins array<int>): each feature's bin. Edges are one row for each feature."""
    long = binning.long_form(df, [key], features)
    if strategy == "uniform":
        e = long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        packed = e.agg(F.sort_array(F.collect_list(F.struct("feature", "lo", "hi"))).alias("_e"))
        cell = lambda k, f: binning.uniform_bin(F.col(f).cast("double"), F.col("_e")[k]["lo"], F.col("_e")[k]["hi"], bins)
    else:
        packed = binning.quantile_edges(long, bins).agg(F.sort_array(F.collect_list(F.struct("feature", "edges"))).alias("_e"))
        cell = lambda k, f: binning.edge_bin(F.col(f).cast("double"), F.col("_e")[k]["edges"])
    return df.join(F.broadcast(packed)).withColumn("bins", F.array(*(cell(k, f) for k, f in enumerate(features)))).drop("_e")


def grow(rows: DataFrame, depth: int, min_leaf: int, by: tuple[str, ...] = (), scale: int = 6) -> DataFrame:
    """One tree (for each value of the columns `by`) over rows (key, bins, g, h): nodes with split or leaf value.

    g and h are summed as decimals, so that sums don't depend on order. A level reads the rows once, for its histograms;
    what a node's children sum up to follows from its own, and the last level reads no rows. Callers write rows first.
    """
    keys = [*by, "node"]
    dec = f"decimal(28,{scale})"
    at = rows.withColumns({"node": F.lit(1).cast("bigint"), "g": F.col("g").cast(dec), "h": F.col("h").cast(dec)})
    add = (F.sum("g").alias("g"), F.sum("h").alias("h"))
    out, totals = None, at.groupBy(*keys).agg(*add, F.count("*").alias("n")) if not depth else None
    for level in range(depth + 1):
        if level < depth:
            hist = materialise(binning.histogram(at.select(*keys, "g", "h", F.posexplode("bins").alias("feature", "bin")), keys))
            if totals is None:
                totals = hist.where("feature = 0").groupBy(*keys).agg(*add, F.sum("n").alias("n"))
            split = binning.best_split(hist, keys, min_leaf).where(F.col("gain") > 0)
            nodes = totals.join(split.select(*keys, "feature", "bin", "gain"), keys, "left")
        else:
            nodes = totals.withColumns({"feature": F.lit(None).cast("int"), "bin": F.lit(None).cast("int"), "gain": F.lit(None).cast("double")})
        nodes = nodes.select(*keys, "feature", "bin", "gain", "n", six_places(binning.leaf_value(F.col("g").cast("double"), F.col("h").cast("double"))).alias("value"))
        told = nodes.collect()  # a level of a model: 2^level rows a tree at most
        nodes = rows.sparkSession.createDataFrame(told, nodes.schema)
        out = nodes if out is None else out.unionByName(nodes)
        going = nodes.where(F.col("feature").isNotNull())
        if level == depth or all(r["feature"] is None for r in told):
            break
        # at most 2^depth rows a tree
        cuts = F.broadcast(going.select(*keys, F.col("feature").alias("_f"), F.col("bin").alias("_b")))
        child = lambda bin_: F.col("node") * 2 + F.when(bin_ <= F.col("_b"), 0).otherwise(1)
        totals = hist.join(cuts, keys).where(F.col("feature") == F.col("_f")).withColumn("node", child(F.col("bin"))).groupBy(*keys).agg(*add, F.sum("n").alias("n"))
        at = at.join(cuts, keys).withColumn("node", child(F.get("bins", F.col("_f")))).drop("_f", "_b")
    return out


def leaf_of(rows: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """rows with node, the leaf reached in a tree: the node table is at most 2^depth rows and is looked up in one map."""
    split = nodes.where(F.col("feature").isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "bin")))).alias("_s"))
    node = F.lit(1).cast("bigint")
    rows = rows.join(F.broadcast(split)).withColumn("node", node)
    for _ in range(depth):
        s = F.col("_s")[F.col("node")]
        rows = rows.withColumn("node", F.when(s.isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(F.get("bins", s["feature"]) <= s["bin"], 0).otherwise(1)))
    return rows.drop("_s")


def tree_values(rows: DataFrame, nodes: DataFrame, classes: int, depth: int) -> DataFrame:
    """rows with `values`: of each class's tree the value of the leaf that the row's bins reach.

    The node tables, classes * 2^(depth + 1) nodes at most, go to the rows as arrays by node number.
    """
    width = 2 ** (depth + 1)
    feature, cut, value = ([None] * (classes * width) for _ in range(3))
    for r in nodes.collect():
        feature[r["class"] * width + r.node], cut[r["class"] * width + r.node], value[r["class"] * width + r.node] = r.feature, r.bin, r.value
    packed = rows.sparkSession.createDataFrame([(feature, cut, value)], "_f array<int>, _b array<int>, _v array<double>")

    def leaf(k):
        def step(node, _):
            f = F.get("_f", k * width + node)
            return F.when(f.isNull(), node).otherwise(node * 2 + F.when(F.get("bins", f) <= F.get("_b", k * width + node), 0).otherwise(1))

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step) if depth else F.lit(1)

    return rows.join(F.broadcast(packed)).withColumn("values", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.get("_v", k * width + leaf(k)))).drop("_f", "_b", "_v")


def softmax(scores: Column) -> Column:
    """Shares of exponentials, shifted by the largest score."""
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def _stepped(now: DataFrame, nodes: DataFrame, classes: int, depth: int, rate: float) -> DataFrame:
    got = tree_values(now, nodes, classes, depth)
    return got.withColumn("pred", F.zip_with("pred", "values", lambda p, v: six_places(p + rate * v))).drop("values")


def fit_classes(rows: DataFrame, classes: int, rounds: int, depth: int, min_leaf: int, rate: float) -> tuple[list[float], DataFrame]:
    """(initial scores, nodes with round and class columns) for softmax loss on rows (key, bins, y: 0 to classes - 1)."""
    rows = materialise(rows)
    count = dict(rows.groupBy("y").count().collect())
    base = [round(math.log(max(count.get(k, 0) / max(1, sum(count.values())), 1e-15)), 6) for k in range(classes)]
    now = rows.withColumn("pred", F.array(*map(F.lit, base)))
    model = None
    for t in range(rounds):
        at = now.select("bins", "y", F.posexplode(softmax(F.col("pred"))).alias("class", "p"))
        grad = at.select("bins", "class", six_places(F.col("p") - (F.col("y") == F.col("class")).cast("int")).alias("g"), six_places(F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-15))).alias("h"))
        nodes = grow(grad, depth, min_leaf, ("class",))
        if t + 1 < rounds:
            now = materialise(_stepped(now, nodes, classes, depth, rate))
        part = nodes.withColumn("round", F.lit(t))
        model = part if model is None else model.unionByName(part)
    return base, model


def predict_classes(rows: DataFrame, base: list[float], model: DataFrame, rounds: int, depth: int, rate: float) -> DataFrame:
    """rows with proba (array by class) and predicted, the likeliest class, the lowest of equals."""
    now = rows.withColumn("pred", F.array(*map(F.lit, base)))
    for t in range(rounds):
        now = _stepped(now, model.where(F.col("round") == t), len(base), depth, rate)
    now = now.withColumn("proba", softmax(F.col("pred")))
    return now.withColumn("predicted", F.array_position("proba", F.array_max("proba")).cast("int") - 1).drop("pred")


def mean_of(y: str) -> Column:
    """The mean of an aggregate, summed as decimals and rounded to six places."""
    return six_places(F.try_divide(F.sum(F.col(y).cast("decimal(28,6)")).cast("double"), F.count(y)))


def fit_regression(rows: DataFrame, trees: int, depth: int, min_leaf: int, rate: float) -> tuple[float, DataFrame]:
    """(initial value, nodes with a tree column) for squared loss on rows (key, bins, y)."""
    rows = materialise(rows)
    base = rows.agg(mean_of("y")).first()[0] or 0.0
    now = rows.withColumn("pred", F.lit(base))
    model = None
    for t in range(trees):
        grad = now.withColumns({"g": six_places(F.col("pred") - F.col("y")), "h": F.lit(1.0)})
        nodes = grow(grad, depth, min_leaf)
        if t + 1 < trees:
            value = F.broadcast(nodes.select("node", F.col("value").alias("_v")))
            now = materialise(leaf_of(now, nodes, depth).join(value, "node").withColumn("pred", six_places(F.col("pred") + rate * F.col("_v"))).drop("_v", "node"))
        part = nodes.withColumn("tree", F.lit(t))
        model = part if model is None else model.unionByName(part)
    return base, model


def predict_regression(rows: DataFrame, base: float, model: DataFrame, trees: int, depth: int, rate: float) -> DataFrame:
    now = rows.withColumn("pred", F.lit(base))
    for t in range(trees):
        nodes = model.where(F.col("tree") == t)
        now = leaf_of(now, nodes, depth).join(F.broadcast(nodes.select("node", F.col("value").alias("_v"))), "node").withColumn("pred", six_places(F.col("pred") + rate * F.col("_v"))).drop("_v", "node")
    return now
