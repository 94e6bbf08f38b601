"""Online Mondrian trees: rows fold into trees one after another, as set operations by level.

A tree takes its rows in the order of their keys. A row adds to each node it passes; where it ends, at a leaf, it widens
the leaf's box, and the wider the step the likelier the leaf splits: at the time tau - log(u) / step, if that is before the
tree's lifetime. The feature is drawn by its share of the step and the threshold between the old box and the row. One side
is a new leaf that is still empty, the other the leaf as it was, with the widened box and the row counted in it.

What a leaf does depends on the rows that reach it, in order, and on nothing else. So all leaves of all trees are
worked on at once: boxes before each row are running minima and maxima (summed up by ranges of keys, so that no task
orders a whole node), each leaf's split is its first row that splits it, and only the rows after that go on to the next
level. A row inside its leaf's box, or inside that of the leaf's first range of keys if it comes later, takes no step and
widens nothing: such rows are left out before rows are ordered, which leaves few where keys don't follow a feature. A level
carries keys and features on; targets are added up once, at the nodes where rows end, and from there to all above. The
result is that of one row after another, and a further batch continues from the nodes that the last one left.

Rows are (key bigint, x array<double>, y array<double>); y is one value, or a one at the row's class. Keys are unique and a
batch's follow those of the batches before; rows with a null key or target take no part, and a null feature takes no step
and goes right. Nodes are (tree, node, depth, feature, threshold, tau, n, sums, los, his): n counts rows, sums adds up the
targets, los and his are the box (nulls while empty). Ids are 1, 2n and 2n + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.randomness import uniform
from weft.operators.storage import materialise

#: Node ids are longs.
MAX_DEPTH = 61
#: Keys are taken in ranges of so many.
RANGE = 1 << 16
#: Node tables of more rows are joined by shuffling.
BROADCAST_NODES = 50_000
LEAST_STEP = 1e-15
_BOX = (("lo", F.min, F.least), ("hi", F.max, F.greatest))


def roots(spark: SparkSession, trees: int, features: int, width: int) -> DataFrame:
    """An empty leaf for each tree; width: how many targets."""
    none, zero = F.array(*[F.lit(None).cast("double")] * features), F.array(*[F.lit(0.0)] * width)
    return spark.range(trees).select(F.col("id").cast("int").alias("tree"), F.lit(1).cast("bigint").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tau"), F.lit(0).cast("bigint").alias("n"), zero.alias("sums"), none.alias("los"), none.alias("his"))


def _small(nodes: DataFrame) -> DataFrame:
    """Nodes (written before, so that counting them is cheap) for a broadcast, if there are few enough."""
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes


def _split_type() -> str:
    return "struct<key: bigint, feature: int, threshold: double, tau: double, below: boolean, los: array<double>, his: array<double>>"


def _pairwise(f):
    return lambda a, b: f(a, b)


def _x(k: int) -> Column:
    return F.get("x", F.lit(k))


def _beyond(k: int, lo: Column, hi: Column) -> Column:
    """Whether feature k widens a box."""
    x = F.col(f"x{k}")
    return x.isNotNull() & (lo.isNull() | (x < lo) | (x > hi))


def _survivors(rows: DataFrame, leaves: DataFrame, ranges: DataFrame, features: int, few: bool) -> DataFrame:
    """Rows (of leaves that may split, with range, tau, los and his) that lie outside the box that their leaf surely has by then."""
    first = ranges.groupBy("tree", "node").agg(F.min_by(F.struct("range", *(f"{s}{k}" for s, _, _ in _BOX for k in range(features))), "range").alias("first"))
    told = leaves.select("tree", "node", "tau", "los", "his").join(first, ["tree", "node"])
    rows = rows.join(F.broadcast(told) if few else told, ["tree", "node"])
    later, outside = F.col("range") > F.col("first.range"), F.lit(False)
    for k in range(features):
        bounds = [F.get(f"{s}s", F.lit(k)) for s, _, _ in _BOX]
        grown = [widest(b, F.col(f"first.{s}{k}")) for b, (s, _, widest) in zip(bounds, _BOX, strict=True)]
        outside = outside | F.when(later, _beyond(k, *grown)).otherwise(_beyond(k, *bounds))
    return rows.where(outside).drop("first")


def _first_splits(at: DataFrame, leaves: DataFrame, features: int, seed: int, lifetime: float, few: bool) -> DataFrame:
    """(tree, node, split) of the leaves that split: the first row to do so, feature, threshold, tau, side and the box then."""
    rows = at.withColumn("range", F.floor(F.col("key") / RANGE))
    keys = ["tree", "node", "range"]
    ranges = materialise(rows.groupBy(*keys).agg(*(f(f"x{k}").alias(f"{s}{k}") for s, f, _ in _BOX for k in range(features))))
    earlier = Window.partitionBy("tree", "node").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*keys, *(f(f"{s}{k}").over(earlier).alias(f"start_{s}{k}") for s, f, _ in _BOX for k in range(features)))
    before = Window.partitionBy(*keys).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = _survivors(rows, leaves, ranges, features, few)
    rows = rows.join(starts, keys).withColumns({f"{s}{k}": widest(F.get(f"{s}s", F.lit(k)), F.col(f"start_{s}{k}"), f(f"x{k}").over(before)) for s, f, widest in _BOX for k in range(features)})
    # an empty box takes no step
    rows = rows.withColumns({f"step{k}": F.coalesce(F.greatest(F.col(f"lo{k}") - F.col(f"x{k}"), F.lit(0.0)), F.lit(0.0)) + F.coalesce(F.greatest(F.col(f"x{k}") - F.col(f"hi{k}"), F.lit(0.0)), F.lit(0.0)) for k in range(features)})
    total = sum((F.col(f"step{k}") for k in range(1, features)), F.col("step0"))
    rows = rows.withColumn("total", total).where(F.col("total") > LEAST_STEP)
    rows = rows.withColumn("at", F.col("tau") - F.log(1 - uniform(seed, "tree", "node", "key")) / F.col("total")).where(F.col("at") < lifetime)
    u, upto, drawn = uniform(seed + 1, "tree", "node", "key") * F.col("total"), F.lit(0.0), []
    for k in range(features):
        upto = upto + F.col(f"step{k}")
        drawn.append(F.when(u <= upto, F.lit(k)))
    of = lambda s: F.get(F.array(*(F.col(f"{s}{k}") for k in range(features))), F.col("feature"))
    rows = rows.withColumn("feature", F.coalesce(*drawn, F.lit(0))).withColumns({"v": of("x"), "lo": of("lo"), "hi": of("hi")})
    u, below = uniform(seed + 2, "tree", "node", "key"), F.col("v") < F.col("lo")
    threshold = F.when(below, F.col("v") + u * (F.col("lo") - F.col("v"))).otherwise(F.col("hi") + u * (F.col("v") - F.col("hi")))
    box = [F.array(*(widest(F.col(f"{s}{k}"), F.col(f"x{k}")) for k in range(features))).alias(f"{s}s") for s, _, widest in _BOX]
    split = F.struct("key", "feature", threshold.alias("threshold"), F.col("at").alias("tau"), below.alias("below"), *box)
    return rows.select("tree", "node", split.alias("split")).groupBy("tree", "node").agg(F.min_by("split", "split.key").alias("split"))


def _gone(at: DataFrame, cuts: DataFrame, features: int, few: bool, how: str) -> DataFrame:
    """Rows at the side of their node's cut that they go to, if they come after it; how: left keeps the others where they are, inner drops them."""
    cuts = F.broadcast(cuts) if few else cuts
    goes = F.col("_f").isNotNull() & (F.col("_k").isNull() | (F.col("key") > F.col("_k")))
    right = F.when(F.get(F.array(*(F.col(f"x{k}") for k in range(features))), F.col("_f")) <= F.col("_t"), 0).otherwise(1)
    out = at.join(cuts, ["tree", "node"], how)
    return (out.where(goes) if how == "inner" else out).withColumn("node", F.when(goes, F.col("node") * 2 + right).otherwise(F.col("node"))).drop("_f", "_t", "_k")


def _added(ends: DataFrame, nodes: DataFrame, features: int, width: int) -> DataFrame:
    """nodes with what their rows add; ends: (tree, node, key, x..., y) of all rows where they end.

    A row adds to the node where it ends and to all above, and a leaf that goes on as a child has counted (taken) the rows that ended above it.
    """
    box = [f"{s}{k}" for s, _, _ in _BOX for k in range(features)]
    sums = [f"y{k}" for k in range(width)]
    ended = ends.groupBy("tree", "node").agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(F.get("y", F.lit(k))), F.lit(0.0)).alias(f"y{k}") for k in range(width)), *(f(f"x{k}").alias(f"{s}{k}") for s, f, _ in _BOX for k in range(features)))
    ended = materialise(ended)
    over = ended.join(nodes.select("tree", "node", "depth"), ["tree", "node"]).select("tree", F.explode(F.expr("transform(sequence(0, depth), i -> shiftright(node, i))")).alias("node"), "rows", *sums, *box)
    taken = nodes.select("tree", F.col("node").alias("_node"), F.explode("taken").alias("node")).join(ended, ["tree", "node"]).select("tree", F.col("_node").alias("node"), "rows", *sums, *(F.lit(None).cast("double").alias(b) for b in box))
    more = over.unionByName(taken).groupBy("tree", "node").agg(F.sum("rows").alias("rows"), F.array(*(F.sum(y) for y in sums)).alias("_sums"), *(F.array(*(f(f"{s}{k}") for k in range(features))).alias(f"_{s}s") for s, f, _ in _BOX))
    there = F.col("rows").isNotNull()
    new = {"n": F.col("n") + F.coalesce("rows", F.lit(0)), "sums": F.when(there, F.zip_with("sums", "_sums", lambda x, y: x + y)).otherwise(F.col("sums"))}
    new |= {f"{s}s": F.when(there, F.zip_with(f"{s}s", f"_{s}s", _pairwise(widest))).otherwise(F.col(f"{s}s")) for s, _, widest in _BOX}
    return nodes.join(more, ["tree", "node"], "left").withColumns(new)


def fold(nodes: DataFrame, rows: DataFrame, trees: int, features: int, width: int, seed: int = 0, lifetime: float = float("inf"), depth: int = MAX_DEPTH) -> DataFrame:
    """The nodes after all rows. Nodes at `depth` don't split."""
    rows = rows.where(F.col("key").isNotNull() & F.col("y").isNotNull()).select(F.col("key").cast("bigint").alias("key"), *(_x(k).alias(f"x{k}") for k in range(features)), "y")
    # rows are read once a level at first; a batch that came as one file would be one task
    rows = materialise(rows.repartition("key")).select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("bigint").alias("node"), "*")
    nodes = materialise(nodes)
    columns, cuts, born, at = nodes.columns, [], None, rows.drop("y")
    old = nodes.withColumn("taken", F.array().cast("array<bigint>"))
    count = {r[0]: r[1] for r in nodes.groupBy("depth").count().collect()}
    level, arriving, done = 0, 0, None
    while True:
        here = old.where(F.col("depth") == level)
        here = here if born is None else here.unionByName(born)
        few = count.get(level, 0) + arriving <= BROADCAST_NODES
        if level < min(depth, MAX_DEPTH):
            here = materialise(here)
            leaves = here.where("feature IS NULL")
            told = here.join(_first_splits(at, leaves, features, seed, lifetime, few), ["tree", "node"], "left")
        else:
            told = here.withColumn("split", F.lit(None).cast(_split_type()))
        new = {"feature": F.coalesce("feature", "split.feature"), "threshold": F.coalesce("threshold", "split.threshold"), "tau": F.coalesce("split.tau", "tau")}
        told = materialise(told.withColumns(new))
        done = told.drop("split") if done is None else done.unionByName(told.drop("split"))
        split, cut = told.agg(F.count("split"), F.count("feature")).first()
        if not cut:
            break
        cuts.append((told.select("tree", "node", F.col("feature").alias("_f"), F.col("threshold").alias("_t"), F.col("split.key").alias("_k")).where("_f IS NOT NULL"), few))
        # where the row lies below the box, the leaf as it was is on the right
        copied = F.when(F.col("split.below"), 1).otherwise(0)
        child = told.where("split IS NOT NULL").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
        copy = F.col("side") == copied
        born = child.select(
            "tree", (F.col("node") * 2 + F.col("side")).alias("node"), F.lit(level + 1).alias("depth"), F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"), F.col("split.tau").alias("tau"),
            F.when(copy, F.col("n")).otherwise(F.lit(0)).alias("n"), F.when(copy, F.col("sums")).otherwise(F.transform("sums", lambda _: F.lit(0.0))).alias("sums"),
            *(F.when(copy, F.col(f"split.{s}s")).otherwise(F.transform(f"{s}s", lambda _: F.lit(None).cast("double"))).alias(f"{s}s") for s, _, _ in _BOX),
            F.when(copy, F.concat("taken", F.array("node"))).otherwise(F.array().cast("array<bigint>")).alias("taken"),
        )
        arriving = 2 * split
        level += 1
        if level < min(depth, MAX_DEPTH):
            at = materialise(_gone(at, cuts[-1][0], features, few, "inner"))
    for cut, few in cuts:
        rows = _gone(rows, cut, features, few, "left")
    return _added(rows, done.unionByName(old.where(F.col("depth") > level)), features, width).select(*columns)


def ended(rows: DataFrame, nodes: DataFrame, trees: int) -> DataFrame:
    """(key, tree, n, sums) of the leaf that each row ends at in each tree, level by level."""
    at = rows.select("key", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("bigint").alias("node"))
    cuts = nodes.select("tree", "node", F.col("feature").alias("_f"), F.col("threshold").alias("_t"), "n", "sums")
    cuts = _small(materialise(cuts))
    for _ in range(nodes.agg(F.max("depth")).first()[0] or 0):
        at = at.join(cuts.drop("n", "sums"), ["tree", "node"]).select("key", "x", "tree", F.when(F.col("_f").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(F.get("x", F.col("_f")) <= F.col("_t"), 0).otherwise(1)).alias("node"))
    return at.join(cuts, ["tree", "node"]).select("key", "tree", "n", "sums")


def class_shares(rows: DataFrame, nodes: DataFrame, trees: int, width: int) -> DataFrame:
    """(key, shares): mean over the trees of the leaves' class shares; an empty leaf has all classes alike."""
    shares = F.transform("sums", lambda c: F.when(F.col("n") > 0, c / F.col("n")).otherwise(F.lit(1.0 / width)))
    got = ended(rows, nodes, trees).withColumn("shares", shares)
    return got.groupBy("key").agg(F.array(*(F.round(F.avg(F.get("shares", F.lit(k))), 9) for k in range(width))).alias("shares"))


def fold_stream(batch: DataFrame, batch_id: int, folder: str, start: DataFrame, **how) -> None:
    """foreachBatch step: the nodes after batch k are written to folder/nodes-k, from those after batch k - 1.

    A batch that runs again after a failure writes its version again, from the same version before it.
    """
    spark = batch.sparkSession
    before = spark.read.schema(start.schema).parquet(f"{folder}/nodes-{batch_id - 1:06d}") if batch_id else start
    fold(before, batch, **how).write.mode("overwrite").parquet(f"{folder}/nodes-{batch_id:06d}")
