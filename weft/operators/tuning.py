"""Forests of several sizes read off one growth: benchmark runs over datasets, methods and seeds, and successive halving.

Draws are hashes of seed, tree and node, so a forest of fewer trees is the first trees of a larger one, and a shallower tree
is the upper levels of a deeper one. All sizes (trees, depth) of a method, and all runs, are therefore grown in one job
and scored in one. Regression trees serve labels of 0 and 1 as well: their variance is half the Gini impurity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.randomness import uniform
from weft.operators import forest
from weft.operators.storage import materialise

Size = tuple[int, int]  # trees, depth


def grown(rows: DataFrame, sizes: list[Size], seed: int, split: str = "best") -> DataFrame:
    """Nodes of the largest forest of every run of rows (run, key, x, y)."""
    trees = max(t for t, _ in sizes)
    first = F.col("run") * trees
    rows = rows.select("run", "key", "x", "y", F.lit(1).alias("weight"))
    return forest.grow(rows, depth=max(k for _, k in sizes), seed=seed, split=split, task="regression", trees=F.sequence(first, first + trees - 1))


def predictions(rows: DataFrame, nodes: DataFrame, sizes: list[Size], largest: list[Size] | None = None) -> DataFrame:
    """Columns of rows (run, key, x, ...) but x, with trees, depth and predicted for each size.

    Each tree is walked once; a size's node is the ancestor at its depth. A run that has no nodes has no predictions.
    largest: the sizes that the nodes were grown for, if these are some of them only.
    """
    got = forest.routed(rows, nodes, sizes, max(t for t, _ in largest or sizes))
    told = F.array(*(F.struct(F.lit(t).alias("trees"), F.lit(k).alias("depth"), F.round(F.get("means", F.lit(i)), 6).alias("predicted")) for i, (t, k) in enumerate(sizes)))
    return got.select(*(c for c in rows.columns if c != "x"), F.inline(told))


def scores(predicted: DataFrame) -> DataFrame:
    """(run, trees, depth, n, mse, accuracy, auc) of rows (run, y, binary, trees, depth, predicted).

    Accuracy at a half and the area under the curve are for binary labels only, the latter null where all labels are equal.
    Rows of binary labels are summed by prediction first; those are shares of six places, so a run's curve has at most
    1,000,001 points.
    """
    size = ["run", "trees", "depth"]
    yes = F.when(F.col("binary"), F.col("y"))
    points = predicted.groupBy(*size, "binary", F.when(F.col("binary"), F.col("predicted")).alias("p")).agg(
        F.count("*").alias("n"), F.sum(F.pow(F.col("predicted") - F.col("y"), 2)).alias("sq"), F.sum(yes).alias("pos"),
        F.sum(F.when(F.col("binary"), ((F.col("predicted") >= 0.5) == (F.col("y") >= 0.5)).cast("long"))).alias("right"))
    neg = F.col("n") - F.col("pos")
    before = F.sum(neg).over(Window.partitionBy(*size).orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    points = points.withColumn("area", F.col("pos") * (F.coalesce(before, F.lit(0)) + neg / 2)).withColumn("neg", neg)
    n = F.sum("n")
    return points.groupBy(*size).agg(n.alias("n"), (F.sum("sq") / n).alias("mse"), (F.sum("right") / n).alias("accuracy"), F.try_divide(F.sum("area"), F.sum("pos") * F.sum("neg")).alias("auc"))


def benchmarked(rows: DataFrame, methods: list[str], sizes: list[Size], seeds: list[int], share: float = 0.75) -> DataFrame:
    """(dataset, method, trees, depth, runs, mse, accuracy, auc): means over the seeds, each with its own split of the rows.

    rows are (dataset, key, x, y, binary), datasets numbered from 0. A run without rows to learn from or to be held out is
    left out, so runs counts those that worked. One growth and one scoring a method, whatever the datasets, sizes and seeds.
    """
    k = len(seeds)
    every = rows.select("*", F.posexplode(F.array(*map(F.lit, seeds))).alias("_i", "seed")).withColumn("run", F.col("dataset") * k + F.col("_i"))
    every = materialise(every.select("run", "key", "x", "y", "binary", (uniform(28, "seed", "key") < share).alias("learn")))
    out = None
    for m in methods:
        nodes = grown(every.where("learn"), sizes, 42, m)
        own = scores(predictions(every.where(~F.col("learn")).select("run", "key", "x", "y", "binary"), nodes, sizes)).withColumn("method", F.lit(m))
        out = own if out is None else out.unionByName(own)
    mean = [F.avg(c).alias(c) for c in ("mse", "accuracy", "auc")]
    return out.groupBy(F.floor(F.col("run") / k).cast("int").alias("dataset"), "method", "trees", "depth").agg(F.count("*").alias("runs"), *mean)


class Halving:
    """Successive halving over sizes: all are scored on held-out rows, the better half goes on with twice the rows; the best is
    grown again on all rows.

    Rows are (key, x, y). Ties go to fewer trees, then to less depth. Without rows to learn from or to score by, every size
    is as bad as the others. What comes to the driver is one score for each size.
    """

    def __init__(self, sizes: list[Size], seed: int = 42, share: float = 0.25, held: float = 0.25):
        self.sizes, self.seed, self.share, self.held = sorted(sizes), seed, share, held
        self.best: Size | None = None
        self.nodes: DataFrame | None = None

    def rungs(self, rows: DataFrame) -> list[tuple[float, int, int, float, int]]:
        """(share, trees, depth, mse, place) of each size in each round; sets best."""
        u = uniform(37, "key")
        rows = materialise(rows.withColumns({"run": F.lit(0), "binary": F.lit(False)}))
        held = rows.where(u < self.held)
        left, share, told = list(self.sizes), self.share, []
        while True:
            nodes = grown(rows.where((u >= self.held) & (u < self.held + (1 - self.held) * share)), left, self.seed)
            got = {(r.trees, r.depth): r.mse for r in scores(predictions(held, nodes, left)).collect()}
            ranked = sorted((got.get(s, float("inf")), *s) for s in left)
            told += [(float(share), t, k, float(mse), place) for place, (mse, t, k) in enumerate(ranked, 1)]
            left = [(t, k) for _, t, k in ranked[: max(1, len(ranked) // 2)]]
            self.best = left[0]
            if len(ranked) == 1 or share >= 1:
                return told
            share = min(1.0, share * 2)

    def fit(self, rows: DataFrame) -> Halving:
        rows = materialise(rows)
        self.rungs(rows)
        self.nodes = grown(rows.withColumn("run", F.lit(0)), [self.best], self.seed)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """(key, predicted) by the forest that was grown again."""
        if self.nodes is None:
            raise ValueError("predict needs a fitted tuner")
        return predictions(rows.select(F.lit(0).alias("run"), "key", "x"), self.nodes, [self.best]).select("key", "predicted")
