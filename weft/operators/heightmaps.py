"""Fractal heightmaps, one for each value of `map`, their border seeds, and rivers, as tables (map, y, x, v)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.randomness import uniform
from weft.operators import grids, sampling
from weft.operators.storage import materialise


#: Heights under this are water where heights are rescaled.
WATER = 50 / 255


def normal(seed: int, *keys: str) -> Column:
    """A standard normal deviate from the hashes of seed and keys (Box-Muller)."""
    return F.sqrt(-2.0 * F.log(1 - uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))


#: Tables of one row for each map are broadcast up to this many rows.
BROADCAST_MAPS = 50_000
#: Maps of at most this many cells are drawn by the task that has their keys; larger ones are tables of cells from the start.
ROW_CELLS = 1 << 14
#: Cells that a task draws, about.
TASK_CELLS = 500_000


def _beside(maps: DataFrame, own: DataFrame, how: str = "inner") -> DataFrame:
    """maps with the row of their map in `own`; of many maps none holds many of all cells, so that they are shuffled."""
    own = materialise(own)
    return maps.join(F.broadcast(own) if own.count() <= BROADCAST_MAPS else own.hint("merge"), "map", how)


def normalised(maps: DataFrame) -> DataFrame:
    """Each map's values from 0 to 1; a flat map is 0."""
    b = maps.groupBy("map").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    span = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    return _beside(maps, b).withColumn("v", (F.col("v") - F.col("_lo")) / span).drop("_lo", "_hi")


def _means(known: DataFrame, offsets: list[tuple[int, int]], fits: Column) -> DataFrame:
    """(map, y, x, v): mean of the known points that lie at the offsets from each place that fits: points send their values."""
    sent = known.select("map", F.explode(F.array(*(F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x")) for a, b in offsets))).alias("p"), "v")
    return sent.select("map", "p.y", "p.x", "v").where(fits).groupBy("map", "y", "x").agg(F.avg("v").alias("v"))


def diamond_square(corners: DataFrame, power: int, roughness: float = 0.5, seed: int = 0, border: float | None = None) -> DataFrame:
    """Maps of 2^power + 1 cells a side, normalised, from corners (map, y, x, v) with y and x 0 or 1.

    Each level halves the step: centres of squares are the mean of their four corners, then midpoints of edges that of
    their two to four neighbours, each with a deviate that shrinks by the roughness from level to level. A border value
    holds for all cells of the edge, corners too. A level works on its own lattice only, by sums of sent values, no join.
    """
    last = 1 << power
    y, x = F.col("y"), F.col("x")
    known = corners.select("map", (y * last).cast("int").alias("y"), (x * last).cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    inside = (y > 0) & (y < last) & (x > 0) & (x < last)
    rim = None
    if border is not None:
        along = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("k")
        sides = F.explode(F.array(*(F.struct(a.alias("y"), b.alias("x")) for a, b in ((F.lit(0), F.col("k")), (F.lit(last), F.col("k")), (F.col("k"), F.lit(0)), (F.col("k"), F.lit(last)))))).alias("p")
        rim = materialise(corners.select("map").distinct().select("map", along).select("map", sides).select("map", "p.*").distinct().withColumn("v", F.lit(float(border))))
    known = materialise(known if rim is None else rim.where((y % last == 0) & (x % last == 0)))
    step, scale = last, 1.0
    while step > 1:
        half = step // 2
        noisy = lambda df, s=scale: materialise(df.withColumn("v", F.col("v") + s * normal(seed, "map", "y", "x")))
        within = (y >= 0) & (y <= last) & (x >= 0) & (x <= last)
        centres = noisy(_means(known, [(a, b) for a in (-half, half) for b in (-half, half)], within))
        known = known.unionByName(centres)
        edges = noisy(_means(known, [(-half, 0), (half, 0), (0, -half), (0, half)], within if rim is None else inside))
        known = known.unionByName(edges)
        if rim is not None:
            known = known.unionByName(rim.where((y % half == 0) & (x % half == 0) & ((y % step != 0) | (x % step != 0))))
        step, scale = half, scale * roughness
    return normalised(known)


def water_exponents(maps: DataFrame, share: float, threshold: float = WATER) -> DataFrame:
    """(map, gamma): the exponent, from 0.1 to 10, that puts `share` of a map's values above 0 under the threshold.

    The value of that rank is found by ranges of values, so that no task orders a whole map.
    """
    above = maps.where("v > 0").withColumn("_tie", F.xxhash64("y", "x"))
    wanted = above.groupBy("map").agg(F.ceil(F.count("*") * F.lit(share)).cast("bigint").alias("_rank"))
    at = _beside(sampling.ranked(above, ["map"], "v", "_tie", "_place"), wanted).where(F.col("_place") == F.col("_rank"))
    return at.select("map", _exponent(F.col("v"), threshold).alias("gamma"))


def _exponent(v: Column, threshold: float = WATER) -> Column:
    """What takes v to the threshold, from 0.1 to 10."""
    gamma = F.coalesce(F.try_divide(F.log(F.lit(threshold)), F.log(v)), F.lit(1.0))
    return F.least(F.greatest(gamma, F.lit(0.1)), F.lit(10.0))


def rescaled_water(maps: DataFrame, share: float) -> DataFrame:
    """Maps whose values are raised to their water exponent."""
    return _beside(maps, water_exponents(maps, share), "left").withColumn("v", F.pow("v", F.coalesce("gamma", F.lit(1.0)))).drop("gamma")


def resized(maps: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Bilinear samples of square maps at x / width * (size - 1): each sample asks for the four cells around it."""
    every = maps.select("map").distinct()
    cells = every.select("map", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("tx"))
    at = cells.withColumns({"fy": F.col("ty") / height * (size - 1), "fx": F.col("tx") / width * (size - 1)})
    far = lambda f, a: F.least(F.floor(f) + a, F.lit(size - 1)).cast("int")
    near = lambda f, a: F.col(f) - F.floor(f) if a else 1 - (F.col(f) - F.floor(f))
    corners = F.array(*(F.struct(far("fy", a).alias("y"), far("fx", b).alias("x"), (near("fy", a) * near("fx", b)).alias("k")) for a in (0, 1) for b in (0, 1)))
    asked = at.select("map", "ty", "tx", F.explode(corners).alias("c")).select("map", "ty", "tx", "c.*")
    return asked.join(maps.hint("merge"), ["map", "y", "x"]).groupBy("map", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("k") * F.col("v")).alias("v"))


def _deviates(seed: int, names: list[bytes], ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """normal() of maps (named as text) at the lattice of ys and xs: (maps, ys, xs)."""
    ends = [b"|%d|%d" % (y, x) for y in ys.tolist() for x in xs.tolist()]
    drawn = [np.array([[int.from_bytes(md5(start + e).digest()[:4], "big") for e in ends] for start in (b"%d|%s" % (s, n) for n in names)], float) / 4294967296.0 for s in (seed, seed + 1)]
    return (np.sqrt(-2.0 * np.log(1 - drawn[0])) * np.cos(2 * math.pi * drawn[1])).reshape(len(names), len(ys), len(xs))


def _scaled(v: np.ndarray) -> np.ndarray:
    lo, hi = v.min((1, 2), keepdims=True), v.max((1, 2), keepdims=True)
    return (v - lo) / np.where(hi == lo, 1.0, hi - lo)


def _drawn(names: list[bytes], power: int, width: int, height: int, seed: int, roughness: float, water: float) -> np.ndarray:
    """heightmap() of a few maps at once: (maps, height, width)."""
    last = 1 << power
    v = np.full((len(names), last + 1, last + 1), -2.0 * roughness)
    step, scale = last, 1.0
    while step > 1:
        half = step // 2
        odd, even = np.arange(half, last, step), np.arange(step, last, step)
        v[:, half::step, half::step] = (v[:, :-1:step, :-1:step] + v[:, :-1:step, step::step] + v[:, step::step, :-1:step] + v[:, step::step, step::step]) / 4 + scale * _deviates(seed, names, odd, odd)
        for ys, xs in ((odd, even), (even, odd)):
            if len(even):
                at = lambda a, b: v[:, (ys + a)[:, None], (xs + b)[None, :]]  # noqa: B023, E731
                v[:, ys[:, None], xs[None, :]] = (at(-half, 0) + at(half, 0) + at(0, -half) + at(0, half)) / 4 + scale * _deviates(seed, names, ys, xs)
        step, scale = half, scale * roughness
    v = _scaled(v)
    for m in v:
        above = np.sort(m[m > 0])
        if len(above):
            top = math.log(above[math.ceil(len(above) * water) - 1])
            m **= min(max(math.log(WATER) / top if top else 1.0, 0.1), 10.0)
    fy, fx = np.arange(height) / height * last, np.arange(width) / width * last
    y, x = np.floor(fy).astype(int), np.floor(fx).astype(int)
    ky, kx = (fy - y)[:, None], (fx - x)[None, :]
    y2, x2 = np.minimum(y + 1, last), np.minimum(x + 1, last)
    at = lambda a, b: v[:, a[:, None], b[None, :]]
    return _scaled((1 - ky) * (1 - kx) * at(y, x) + (1 - ky) * kx * at(y, x2) + ky * (1 - kx) * at(y2, x) + ky * kx * at(y2, x2))


def _small_heightmaps(keys: DataFrame, power: int, width: int, height: int, seed: int, roughness: float, water: float) -> DataFrame:
    """heightmap() of maps of a bounded number of cells: a task draws one slice of maps after another, and only the keys are shuffled."""
    size = (1 << power) + 1
    few = max(1, ROW_CELLS // size**2)
    ys, xs = (x.ravel().astype(np.int32) for x in np.mgrid[:height, :width])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), few):
                maps = batch.slice(k, few)
                v = _drawn([n.encode() for n in maps.column(1).to_pylist()], power, width, height, seed, roughness, water)
                of = pa.array(np.repeat(np.arange(len(maps)), width * height))
                yield pa.RecordBatch.from_arrays([maps.column(0).take(of), pa.array(np.tile(ys, len(maps))), pa.array(np.tile(xs, len(maps))), pa.array(v.ravel())], names=["map", "y", "x", "v"])

    tasks = max(1, -(-keys.count() * size * size // TASK_CELLS))
    own = keys.select("map").where("map IS NOT NULL").repartition(tasks, "map").distinct()
    return own.select("map", F.col("map").cast("string").alias("name")).mapInArrow(work, f"map {keys.schema['map'].dataType.simpleString()}, y int, x int, v double")


def heightmap(keys: DataFrame, width: int, height: int, seed: int = 0, roughness: float = 0.55, water: float = 0.28) -> DataFrame:
    """A map of width by height for each key (map): a fractal whose border lies low, with a share of water, resampled."""
    power = max(5, (max(width, height) - 1).bit_length())
    if ((1 << power) + 1) ** 2 <= ROW_CELLS:
        return _small_heightmaps(keys, power, width, height, seed, roughness, water)
    ends = F.explode(F.array(*(F.struct(F.lit(a).alias("y"), F.lit(b).alias("x"), F.lit(0.0).alias("v")) for a in (0, 1) for b in (0, 1)))).alias("p")
    raw = diamond_square(keys.select("map", ends).select("map", "p.*"), power, roughness, seed, border=-2 * roughness)
    return normalised(materialise(resized(rescaled_water(materialise(raw), water), (1 << power) + 1, width, height)))


def border_points(sizes: DataFrame) -> DataFrame:
    """(map, k, y, x) of maps (map, width, height, regions): spaced points along the edges, then the corners, repeats kept.

    The spacing is the longer side over the root of the number of regions (8 at least), and 2 at least.
    """
    w, h = F.col("width"), F.col("height")
    s = sizes.withColumn("spacing", F.greatest(F.lit(2), F.floor(F.greatest(w, h) / F.greatest(F.lit(8.0), F.sqrt("regions"))).cast("int")))
    place = lambda y, x: F.struct(F.lit(y).cast("double").alias("y") if isinstance(y, int) else y.cast("double").alias("y"), F.lit(x).cast("double").alias("x") if isinstance(x, int) else x.cast("double").alias("x"))
    along = lambda n: F.sequence(F.lit(0), n - 1, F.col("spacing"))
    top = F.flatten(F.transform(along(w), lambda i: F.array(place(0, i), place(h - 1, i))))
    side = F.flatten(F.transform(along(h), lambda i: F.array(place(i, 0), place(i, w - 1))))
    ends = F.array(place(0, 0), place(0, w - 1), place(h - 1, 0), place(h - 1, w - 1))
    return s.select("map", F.posexplode(F.concat(top, side, ends)).alias("k", "p")).select("map", "k", "p.y", "p.x")


def falloff(maps: DataFrame, width: int, height: int, share: float = 0.12) -> DataFrame:
    """Maps that sink towards their border, over a margin of `share` of the shorter side."""
    if share <= 0:
        return maps
    return maps.withColumn("v", grids.edge_falloff(F.col("v"), F.col("y"), F.col("x"), height, width, max(1.0, min(width, height) * share), WATER * 0.25))


def region_seeds(keys: DataFrame, width: int, height: int, regions: int, seed: int) -> DataFrame:
    """(map, k, sy, sx): `regions` seeds drawn inside each map, then its border points."""
    inner = keys.select("map", F.explode(F.sequence(F.lit(0), F.lit(max(1, regions) - 1))).alias("k"))
    inner = inner.select("map", "k", (uniform(seed, "map", "k") * height).alias("sy"), (uniform(seed + 1, "map", "k") * width).alias("sx"))
    rim = border_points(keys.select("map", F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(regions).alias("regions")))
    return inner.unionByName(rim.select("map", (F.col("k") + max(1, regions)).alias("k"), F.col("y").alias("sy"), F.col("x").alias("sx")))


def sampled(keys: DataFrame, width: int, height: int, samples: int, seed: int = 0, roughness: float = 0.55, water: float = 0.28, regions: int = 180, rounds: int = 3, margin: float = 0.12) -> DataFrame:
    """(map, ty, tx, mean, centre): maps of width by height tiles of samples by samples cells.

    The fine map sinks at its border, is blended with the means of regions around seeds (relaxed so many rounds, the
    border's stay) and sinks again.
    """
    w, h = width * samples, height * samples
    fine = materialise(falloff(heightmap(keys, w, h, seed, roughness, water), w, h, margin))
    if regions > 0:
        seeds = materialise(region_seeds(keys, w, h, regions, seed + 7))
        for _ in range(rounds):
            middle = grids.nearest_seed(fine, seeds, ["map"]).groupBy("map", F.col("seed").alias("k")).agg(F.avg("y").alias("my"), F.avg("x").alias("mx"))
            inner = F.col("k") < max(1, regions)
            seeds = materialise(seeds.join(middle.hint("merge"), ["map", "k"], "left").select("map", "k", F.when(inner, F.coalesce("my", "sy")).otherwise(F.col("sy")).alias("sy"), F.when(inner, F.coalesce("mx", "sx")).otherwise(F.col("sx")).alias("sx")))
        near = materialise(grids.nearest_seed(fine, seeds, ["map"]))
        means = near.groupBy("map", "seed").agg(F.avg("v").alias("m"))
        blended = near.join(means.hint("merge"), ["map", "seed"]).select("map", "y", "x", (0.82 * F.col("m") + 0.18 * F.col("v")).alias("v"))
        fine = falloff(normalised(materialise(blended)), w, h, margin)
    mid = (F.col("y") % samples == samples // 2) & (F.col("x") % samples == samples // 2)
    return fine.groupBy("map", F.floor(F.col("y") / samples).alias("ty"), F.floor(F.col("x") / samples).alias("tx")).agg(F.avg("v").alias("mean"), F.max(F.when(mid, F.col("v"))).alias("centre"))


def rivers(maps: DataFrame, width: int, height: int, water: float = 0.28, hills: float = 0.62, least: int = 6) -> DataFrame:
    """(map, river, y, x): the cells above water of each map's rivers.

    Rivers are steepest descents from hills, highest first, that reach water in at least `least` cells; a source that lies
    in an earlier river is none. Of an order of choices, one is settled when no open one before it holds its source, so
    that many are settled at a time: a round accepts the sources that no open river runs over, and drops those that an
    accepted one does. Of each map the first three to seven stay, by its area.
    """
    # maps are laid out below one another with a gap, so that they are one sparse grid
    gap = height + 2
    laid = maps.withColumn("y", F.col("map") * gap + F.col("y")).select("map", "y", "x", "v")
    paths = grids.descents(laid.select("y", "x", "v"), water, width + height)
    sources = laid.where(F.col("v") >= hills).select("map", F.col("y").alias("y0"), F.col("x").alias("x0"), "v")
    valid = paths.where((F.size("path") >= least) & F.col("wet")).join(sources.hint("merge"), ["y0", "x0"])
    valid = materialise(valid.select("map", "v", grids.cell("y0", "x0").alias("id"), "y0", "x0", "path"))
    # ids grow with y and x, which is the order of equal heights
    runs = valid.select("map", "v", "id", F.explode("path").alias("over"))
    later = valid.select(F.col("v").alias("v2"), F.col("id").alias("over"))
    edges = materialise(runs.join(later.hint("merge"), "over").where((F.col("v2") < F.col("v")) | ((F.col("v2") == F.col("v")) & (F.col("over") > F.col("id")))).select("id", "over"))
    open_, accepted = materialise(valid.select("id")), None
    while open_.limit(1).count():
        held = edges.join(open_.hint("merge"), "id", "left_semi").select(F.col("over").alias("id")).distinct()
        chosen = materialise(open_.join(held.hint("merge"), "id", "left_anti"))
        accepted = chosen if accepted is None else accepted.unionByName(chosen)
        gone = edges.join(chosen.hint("merge"), "id", "left_semi").select(F.col("over").alias("id")).unionByName(chosen).distinct()
        open_ = materialise(open_.join(gone.hint("merge"), "id", "left_anti"))
    accepted = open_ if accepted is None else accepted
    first = Window.partitionBy("map").orderBy(F.desc("v"), "id")
    most = max(3, min(7, width * height // 500))
    taken = valid.join(accepted.hint("merge"), "id", "left_semi").withColumn("river", F.row_number().over(first)).where(F.col("river") <= most)
    # the last cell of a path is water
    cells = taken.select("map", "river", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("c"))
    return cells.select("map", "river", (F.shiftright("c", 32) - F.col("map") * gap).cast("int").alias("y"), F.col("c").bitwiseAND((1 << 32) - 1).cast("int").alias("x"))
