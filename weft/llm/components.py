"""Connected components as joins, and a bitmap of ids of fixed size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import materialise


#: Parts that the nodes of one label are dealt into.
SALTS = 32


def spread_labels(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (a, b) reach from each linked node.

    In each round a node takes its neighbours' smallest label and then the label of that label's own node, so that
    rounds grow with the logarithm of a chain's length. Each round is written to shared storage; only whether something
    changed comes to the driver.
    """
    both = materialise(links.union(links.select("b", "a")).toDF("node", "other").distinct())
    now = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        heard = both.join(now.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("heard"))
        moved = now.join(heard, "node").select("node", "label", F.least("label", "heard").alias("low"))
        # what the node that gave the label has heard meanwhile; the nodes of a large component are many of one label
        via = moved.where("low != node").select(F.col("node").alias("home"), F.col("low").alias("far"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        nxt = moved.join(via, (F.col("low") == F.col("home")) & (F.pmod(F.xxhash64("node"), F.lit(SALTS)) == F.col("salt")), "left").select("node", "label", F.least("low", F.coalesce("far", "low")).alias("new"))
        nxt = materialise(nxt.select("node", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("changed")))
        if not nxt.where("changed").limit(1).count():
            return nxt.select("node", "label")
        now = nxt.select("node", "label")


class Bitmap:
    """Which longs may be in a column: some 16 bits for each, by hash. Some others seem to be in it, none is missed.

    The bitmap has LEAST to MOST bits (64 MB); with more longs it lets more others pass.
    """

    LEAST, MOST = 1 << 22, 1 << 29

    def __init__(self, words: np.ndarray, df: DataFrame):
        self.bits = len(words) * 64
        self._shared = df.sparkSession.sparkContext.broadcast(words)

    @classmethod
    def of(cls, df: DataFrame, column: str, count: int | None = None) -> Bitmap:
        """Bits are gathered by word in Spark; the driver gets the words. count: how many longs there are, if known."""
        bits = cls.LEAST
        count = df.count() if count is None else count
        while bits < cls.MOST and bits < 16 * count:
            bits *= 2
        at = df.select(_place(column, bits).alias("at"))
        got = at.select(F.expr("at div 64").cast("int").alias("w"), F.expr("shiftleft(1L, at % 64)").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[got.column("w").to_numpy()] = got.column("bits").to_numpy()
        return cls(words, df)

    def place(self, column: str) -> Column:
        return _place(column, self.bits)

    def mask(self, at: np.ndarray) -> np.ndarray:
        """Of places (place() of a column) whether they are set."""
        return (self._shared.value[at >> 6] >> (at & 63)) & 1 == 1


def _place(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits)).cast("int")
