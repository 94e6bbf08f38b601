"""Grids as tables (y, x, v): tiles, nearest seeds, resampling, neighbours, components, descent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.storage import materialise

FOUR = [(-1, 0), (0, 1), (1, 0), (0, -1)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def normalised(grid: DataFrame) -> DataFrame:
    """Values from 0 to 1; a flat grid is 0."""
    b = grid.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    return grid.join(F.broadcast(b)).withColumn("v", (F.col("v") - F.col("lo")) / span).drop("lo", "hi")


def tiles(grid: DataFrame, s: int) -> DataFrame:
    """(ty, tx, mean, centre) of s by s tiles."""
    mid = (F.col("y") % s == s // 2) & (F.col("x") % s == s // 2)
    return grid.groupBy(F.floor(F.col("y") / s).alias("ty"), F.floor(F.col("x") / s).alias("tx")).agg(F.avg("v").alias("mean"), F.max(F.when(mid, F.col("v"))).alias("centre"))


#: Parts that the cells of one label are dealt into.
SALTS = 32
#: Tile tables of more rows are joined by shuffling.
BROADCAST_TILES = 50_000


def nearest_seed(grid: DataFrame, seeds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """grid with seed, the number k of the nearest seed (k, sy, sx), the first of equally near ones; of each value of `by` apart.

    Tiles halve twice from level to level, from one that holds all cells down to cells. Each keeps the seeds that may be
    nearest to a cell of it: those whose least distance to the tile is at most the smallest largest distance of any seed.
    So seeds meet the tiles around them, and no cell sees them all. Cells lie at whole y and x of 0 or more.
    """
    by = by or []
    ends = grid.agg(F.max("y"), F.max("x")).first()
    size = 1
    while size <= max(int(e or 0) for e in ends):
        size *= 4
    tile = [*by, "ty", "tx"]
    at = seeds.select(*by, F.lit(0).cast("bigint").alias("ty"), F.lit(0).cast("bigint").alias("tx"), "k", F.col("sy").cast("double").alias("sy"), F.col("sx").cast("double").alias("sx"))
    while size > 1:
        size //= 4
        parts = F.explode(F.array(*(F.struct((F.col("ty") * 4 + a).alias("ty"), (F.col("tx") * 4 + b).alias("tx")) for a in range(4) for b in range(4)))).alias("t")
        at = at.select(*by, parts, "k", "sy", "sx").select(*by, "t.*", "k", "sy", "sx").where((F.col("ty") * size <= ends[0]) & (F.col("tx") * size <= ends[1]))
        low, high = [], []
        for t, s in (("ty", "sy"), ("tx", "sx")):
            a, b = F.col(t) * size - F.col(s), F.col(t) * size + (size - 1) - F.col(s)
            near, far = F.greatest(a, -b, F.lit(0.0)), F.greatest(F.abs(a), F.abs(b))
            low.append(near * near)
            high.append(far * far)
        at = materialise(at.withColumns({"d": low[0] + low[1], "far": high[0] + high[1]}))
        if size > 1:
            reach = materialise(at.groupBy(*tile).agg(F.min("far").alias("reach")))
            reach = F.broadcast(reach) if reach.count() <= BROADCAST_TILES else reach.hint("merge")
            at = at.join(reach, tile).where("d <= reach").drop("reach", "d", "far")
    if "d" not in at.columns:  # one cell at most
        at = at.withColumn("d", F.col("sy") * F.col("sy") + F.col("sx") * F.col("sx"))
    best = at.groupBy(*tile).agg(F.min_by("k", F.struct("d", "k")).alias("seed"))
    return grid.join(best.withColumnsRenamed({"ty": "y", "tx": "x"}).hint("merge"), [*by, "y", "x"])


def region_blend(grid: DataFrame, share: float = 0.82) -> DataFrame:
    """Blend each cell with its region's mean."""
    means = grid.groupBy("seed").agg(F.avg("v").alias("m"))
    return grid.join(F.broadcast(means), "seed").withColumn("v", share * F.col("m") + (1 - share) * F.col("v")).drop("m")


def relaxed(seeds: DataFrame, grid: DataFrame, rounds: int, border: int) -> DataFrame:
    """Lloyd's relaxation: seeds from index `border` on move to their region's middle each round."""
    for _ in range(rounds):
        middle = nearest_seed(grid, seeds).groupBy(F.col("seed").alias("k")).agg(F.avg("y").alias("my"), F.avg("x").alias("mx"))
        moves = F.col("k") >= border
        seeds = materialise(seeds.join(middle, "k", "left").select("k", F.when(moves, F.coalesce("my", "sy")).otherwise(F.col("sy")).alias("sy"), F.when(moves, F.coalesce("mx", "sx")).otherwise(F.col("sx")).alias("sx")))
    return seeds


def resized(grid: DataFrame, w: int, h: int, to_w: int, to_h: int) -> DataFrame:
    """Bilinear samples at x / to_w * (w - 1): every source cell sends its weight to the samples it bears on."""
    cells = grid.sparkSession.range(to_w * to_h).select(F.floor(F.col("id") / to_w).cast("int").alias("ty"), (F.col("id") % to_w).cast("int").alias("tx"))
    at = cells.withColumns({"fy": F.col("ty") / to_h * (h - 1), "fx": F.col("tx") / to_w * (w - 1)})
    corners = F.explode(F.array(*(F.struct(F.least(F.floor("fy") + a, F.lit(h - 1)).cast("int").alias("y"), F.least(F.floor("fx") + b, F.lit(w - 1)).cast("int").alias("x"), ((1 - a + (2 * a - 1) * (F.col("fy") - F.floor("fy"))) * (1 - b + (2 * b - 1) * (F.col("fx") - F.floor("fx")))).alias("k")) for a in (0, 1) for b in (0, 1))))
    return at.select("ty", "tx", corners.alias("c")).select("ty", "tx", "c.*").join(grid, ["y", "x"]).groupBy("ty", "tx").agg(F.sum(F.col("k") * F.col("v")).alias("v"))


def edge_falloff(v: Column, y: Column, x: Column, h: int, w: int, margin: float, low: float) -> Column:
    """Blend towards `low` near the border by a smooth step."""
    d = F.least(y, x, h - 1 - y, w - 1 - x) / F.lit(margin)
    t = F.greatest(F.least(d, F.lit(1.0)), F.lit(0.0))
    s = t * t * (3 - 2 * t)
    return low + (v - low) * s


def neighbours(grid: DataFrame, offsets: list[tuple[int, int]], columns: list[str]) -> DataFrame:
    """(y, x, n_<column>...) for each neighbour that exists: cells send themselves to their neighbours' places."""
    sent = grid.select(F.explode(F.array(*(F.struct((F.col("y") - a).alias("y"), (F.col("x") - b).alias("x"), F.lit(k).alias("direction")) for k, (a, b) in enumerate(offsets)))).alias("p"), *(F.col(c).alias(f"n_{c}") for c in columns))
    return sent.select("p.*", *(f"n_{c}" for c in columns)).join(grid.select("y", "x").hint("merge"), ["y", "x"], "left_semi")


def components(cells: DataFrame) -> DataFrame:
    """cells (y, x, class) with label: the smallest scan index of the 4-connected cells of one class."""
    now = materialise(cells.select("y", "x", "class", (F.col("y").cast("bigint") * (1 << 32) + F.col("x")).alias("label")))
    while True:
        low = neighbours(now, FOUR, ["class", "label"]).groupBy("y", "x", F.col("n_class").alias("class")).agg(F.min("n_label").alias("n"))
        heard = now.join(low, ["y", "x", "class"], "left").withColumn("new", F.least("label", F.coalesce("n", "label")))
        # follow the label's own cell, so that rounds grow with the logarithm of a component's width; where that has heard
        # of another, it is told to each part of the cells of its label, as a large component's cells are many of one label
        home = heard.where("new < label").select((F.col("y").cast("bigint") * (1 << 32) + F.col("x")).alias("home"), F.col("new").alias("far"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        own = (F.col("new") == F.col("home")) & (F.pmod(F.xxhash64("y", "x"), F.lit(SALTS)) == F.col("salt"))
        nxt = materialise(heard.drop("n").join(home, own, "left").select("y", "x", "class", F.least("new", F.coalesce("far", "new")).alias("new"), "label"))
        if not nxt.where("new < label").limit(1).count():
            return nxt.select("y", "x", "class", "label")
        now = nxt.select("y", "x", "class", F.col("new").alias("label"))


def downhill(grid: DataFrame) -> DataFrame:
    """(y, x, ny, nx): the lowest 4-neighbour of each cell, in the order N, E, S, W of equal ones."""
    n = neighbours(grid.withColumns({"yy": F.col("y"), "xx": F.col("x")}), FOUR, ["v", "yy", "xx"])
    # offsets were turned around when sent: direction k is that of the receiver's neighbour at minus the offset
    order = F.element_at(F.create_map(*[F.lit(z) for k, (a, b) in enumerate(FOUR) for z in (k, FOUR.index((a, b)))]), F.col("direction"))
    return n.groupBy("y", "x").agg(F.min_by(F.struct("n_yy", "n_xx", "n_v"), F.struct("n_v", order)).alias("m")).select("y", "x", F.col("m.n_yy").alias("ny"), F.col("m.n_xx").alias("nx"), F.col("m.n_v").alias("nv"))


def cell(y: str, x: str) -> Column:
    """One number for a cell, in the order of y and x."""
    return F.col(y).cast("bigint") * (1 << 32) + F.col(x).cast("bigint")


def descents(grid: DataFrame, water: float, steps: int, rise: float = 0.03) -> DataFrame:
    """(y0, x0, path, wet): the cells of the steepest descent from each cell above water, stopped by water, a rise or a revisit.

    A cell has one way down, so that paths double from round to round: each is continued by its last cell's own.
    """
    step = downhill(grid).join(grid.hint("merge"), ["y", "x"]).where((F.col("v") >= water) & (F.col("nv") <= F.col("v") + rise))
    at = materialise(step.select(cell("y", "x").alias("c"), F.array(cell("y", "x"), cell("ny", "nx")).alias("path"), cell("ny", "nx").alias("end"), (F.col("nv") < water).alias("wet")))
    for _ in range(max(0, (steps - 1).bit_length())):
        on = at.select(F.col("c").alias("end"), F.slice("path", 2, 1 << 30).alias("more"), F.col("end").alias("far"), F.col("wet").alias("far_wet"))
        at = materialise(at.join(on.hint("merge"), "end", "left").select("c", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"), F.coalesce("far", "end").alias("end"), F.coalesce("far_wet", "wet").alias("wet"), F.col("more").isNotNull().alias("moved")))
        if not at.where("moved").limit(1).count():
            break
        at = at.drop("moved")
    seen_before = F.filter(F.sequence(F.lit(2), F.size("path")), lambda i: F.array_contains(F.slice("path", F.lit(1), i - 1), F.get("path", i - 1)))
    revisits = F.size(F.array_distinct("path")) < F.size("path")
    cut = F.when(revisits, F.slice("path", F.lit(1), F.get(seen_before, F.lit(0)) - 1)).otherwise(F.col("path"))
    at = at.withColumn("path", F.slice(cut, 1, steps + 1)).withColumn("wet", F.col("wet") & (F.col("end") == F.element_at("path", -1)))
    dry = grid.where(F.col("v") >= water).select(F.col("y").alias("y0"), F.col("x").alias("x0"), cell("y", "x").alias("c"))
    return dry.join(at.hint("merge"), "c", "left").select("y0", "x0", F.coalesce("path", F.array("c")).alias("path"), F.coalesce("wet", F.lit(False)).alias("wet"))


def descent_paths(grid: DataFrame, water: float, steps: int, rise: float = 0.03) -> DataFrame:
    """(y0, x0, length, ends_in_water) of steepest descents from all cells above water."""
    return descents(grid, water, steps, rise).select("y0", "x0", F.size("path").alias("length"), F.col("wet").alias("ends_in_water"))
