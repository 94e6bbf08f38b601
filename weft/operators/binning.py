"""Bins, histograms, best splits, encoders and colour ramps over numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.storage import materialise


def long_form(df: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """(key, feature, v): one row for each value."""
    return df.select(*key, F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(f).cast("double").alias("v")) for k, f in enumerate(features)))).alias("e")).select(*key, "e.feature", "e.v")


def uniform_edges(long: DataFrame, bins: int) -> DataFrame:
    """(feature, lo, hi) of equal-width bins."""
    return long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def uniform_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin, the last closed; 0 for a constant column."""
    width = (hi - lo) / bins
    return F.when(hi <= lo, 0).otherwise(F.least(F.floor(F.try_divide(v - lo, width)), F.lit(bins - 1))).cast("int")


def quantile_edges(long: DataFrame, bins: int, few_rule: bool = True) -> DataFrame:
    """(feature, edges): exact nearest-rank quantiles, repeats of the edge before dropped, and the largest value at the end in any case.

    With few_rule a feature of at most `bins` rows has all its distinct values instead. Values are counted, dealt into
    ranges and written; ranks within a range start from the counts of the ranges before it, so that no task ranks a
    whole feature.
    """
    counted = long.groupBy("feature", "v").agg(F.count("*").alias("c"))
    dealt = materialise(counted.repartitionByRange("feature", "v").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("feature", "part").agg(F.sum("c").alias("size"), F.max("v").alias("top"))
    # a row for each range
    whole = Window.partitionBy("feature")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("feature", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(whole).alias("n"), F.max("top").over(whole).alias("hi"))
    # a value covers ranks upto - c .. upto - 1; wanted ranks are bround(i * (n - 1) / bins)
    within = Window.partitionBy("feature", "part").orderBy("v")
    ranked = dealt.join(F.broadcast(starts), ["feature", "part"]).withColumn("upto", F.col("start") + F.sum("c").over(within))
    first = F.ceil((F.col("upto") - F.col("c") - 0.5) * bins / (F.col("n") - 1)) - 1
    near = F.transform(F.sequence(F.lit(-1), F.lit(2)), lambda k: F.bround((first + k) * (F.col("n") - 1) / F.lit(float(bins))).cast("bigint"))
    asked = F.transform(F.sequence(F.lit(-1), F.lit(2)), lambda k: (first + k >= 0) & (first + k <= bins - 1))
    covers = F.exists(F.arrays_zip(near.alias("r"), asked.alias("a")), lambda x: x["a"] & (x["r"] >= F.col("upto") - F.col("c")) & (x["r"] < F.col("upto")))
    # one row has rank 0 for all wanted ranks; a value with many rows may cover several, one of which is among the first
    hit = F.when(F.col("n") == 1, F.lit(True)).otherwise(covers)
    keep = (hit | (F.col("n") <= bins)) if few_rule else hit
    edges = ranked.where(keep).groupBy("feature", "n", "hi").agg(F.sort_array(F.collect_list("v")).alias("e"))
    return edges.select("feature", F.array_append("e", F.col("hi")).alias("edges"))


def edge_bin(v: Column, edges: Column) -> Column:
    """The last j with v >= edges[j], 0 at least, the last bin at most."""
    return F.greatest(F.least(F.size(F.filter(edges, lambda e: e <= v)) - 1, F.size(edges) - 2), F.lit(0)).cast("int")


def histogram(binned: DataFrame, node: list[str]) -> DataFrame:
    """Sums of g (exact decimals where given), h and rows by node, feature and bin."""
    return binned.groupBy(*node, "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def best_split(hist: DataFrame, node: list[str], min_leaf: int = 20) -> DataFrame:
    """The split (feature, bin) of largest gain of each node, ties to the lowest feature, then bin."""
    w = Window.partitionBy(*node, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*node, "feature")
    d = lambda c: F.col(c).cast("double")
    s = hist.withColumns({"gl": F.sum("g").over(w), "hl": F.sum("h").over(w), "nl": F.sum("n").over(w), "gt": F.sum("g").over(whole), "ht": F.sum("h").over(whole), "nt": F.sum("n").over(whole)})
    s = s.withColumns({"gr": d("gt") - d("gl"), "hr": d("ht") - d("hl"), "nr": F.col("nt") - F.col("nl")}).where((F.col("nl") >= min_leaf) & (F.col("nr") >= min_leaf) & (d("hl") >= 1e-15) & (F.col("hr") >= 1e-15))
    gain = 0.5 * (d("gl") * d("gl") / d("hl") + F.col("gr") * F.col("gr") / F.col("hr") - d("gt") * d("gt") / d("ht"))
    s = s.withColumn("gain", F.round(gain, 3))
    rank = Window.partitionBy(*node).orderBy(F.desc("gain"), "feature", "bin")
    return s.withColumn("r", F.row_number().over(rank)).where(F.col("r") == 1).select(*node, "feature", "bin", "gain", F.col("nl").alias("n_left"), F.col("nr").alias("n_right"))


def leaf_value(g: Column, h: Column) -> Column:
    return -g / F.greatest(h, F.lit(1e-15))


def piecewise_linear(v: Column, edges: Column) -> Column:
    """Weights over the edges: shares of the two ends of the first bracket that holds v; one outside."""
    n = F.size(edges)
    brackets = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda j: (n > 1) & (F.get(edges, j + 1) > F.get(edges, j)))
    j = F.get(F.filter(brackets, lambda k: (v >= F.get(edges, k)) & (v <= F.get(edges, k + 1))), F.lit(0))
    lo, hi = F.get(edges, j), F.get(edges, j + 1)
    outside = F.when((F.size(brackets) == 0) | (v < F.get(edges, F.lit(0))), 0).otherwise(n - 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(j.isNotNull(), F.when(k == j, (hi - v) / (hi - lo)).when(k == j + 1, (v - lo) / (hi - lo)).otherwise(0.0)).otherwise(F.when(k == outside, 1.0).otherwise(0.0)))


def densified(edges: Column, rounds: int = 1) -> Column:
    """Edges with midpoints inserted, `rounds` times over."""
    for _ in range(rounds):
        e = edges
        mid = F.zip_with(F.slice(e, 1, F.size(e) - 1), F.slice(e, 2, F.size(e) - 1), lambda a, b: (a + b) / 2)
        edges = F.array_sort(F.array_distinct(F.concat(e, mid)))
    return edges


def threshold_class(v: Column, cuts: list[float], names: list[str]) -> Column:
    out = F.lit(names[-1])
    for c, n in reversed(list(zip(cuts, names, strict=False))):
        out = F.when(v < c, n).otherwise(out)
    return out


def colour_ramp(v: Column, stops: list[tuple[float, int, int, int]]) -> Column:
    """(r, g, b) by linear interpolation between stops, clamped and truncated."""
    x = F.greatest(F.least(v, F.lit(stops[-1][0])), F.lit(stops[0][0]))

    def channel(k: int) -> Column:
        out = F.lit(float(stops[-1][k]))
        for a, b in reversed(list(zip(stops, stops[1:], strict=False))):
            out = F.when(x < b[0], a[k] + (b[k] - a[k]) * (x - a[0]) / (b[0] - a[0])).otherwise(out)
        return out.cast("int")

    return F.struct(*(channel(k).alias(n) for k, n in ((1, "r"), (2, "g"), (3, "b"))))
