"""Fitted forests as tables: relabelling between kinds, flat export, leaf boxes, thresholds as bin edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import binning
from weft.operators.forest import average_path


def relabelled(nodes: DataFrame, kind: str) -> DataFrame:
    """The same nodes under another kind's name; splits and leaves are shared, not copied."""
    return nodes.withColumn("kind", F.lit(kind))


def as_isolation(nodes: DataFrame) -> DataFrame:
    """Nodes with path lengths to score by: depth and the expected rest below a leaf, over that of the roots' mean size."""
    root = nodes.where("node = 1").agg(F.avg("n").alias("_m"))
    return relabelled(nodes, "isolation").join(F.broadcast(root)).withColumn("c", average_path(F.col("_m"))).withColumn("length", F.when(F.col("feature").isNull(), F.col("depth") + average_path(F.col("n")))).drop("_m")


def flat_table(nodes: DataFrame) -> DataFrame:
    """(tree, node, mode, feature, threshold, true_node, false_node): branches and leaves in one table."""
    branch = F.col("feature").isNotNull()
    return nodes.select("tree", "node", F.when(branch, "branch_leq").otherwise("leaf").alias("mode"), "feature", "threshold", F.when(branch, F.col("node") * 2).alias("true_node"), F.when(branch, F.col("node") * 2 + 1).alias("false_node"))


def harvested_edges(nodes: DataFrame, ranges: DataFrame, brackets: int) -> DataFrame:
    """(feature, edges): a forest's thresholds by feature, rounded, with midpoints until there are enough brackets; the range where a feature has less than two."""
    cuts = nodes.where(F.col("feature").isNotNull()).groupBy("feature").agg(F.array_sort(F.collect_set(F.round("threshold", 10))).alias("e"))
    both = ranges.join(cuts, "feature", "left").withColumn("e", F.when(F.coalesce(F.size("e"), F.lit(0)) < 2, F.array("lo", "hi")).otherwise(F.col("e")))
    e = F.col("e")
    for _ in range(max(1, (brackets - 1).bit_length())):
        e = F.when(F.size(e) - 1 < brackets, binning.densified(e)).otherwise(e)
        both = both.withColumn("e", e)
        e = F.col("e")
    return both.select("feature", F.col("e").alias("edges"))
