"""Heightmaps, their border seeds and their rivers, a map for each supplier (X01, X03, X05, X06 and X12 rows)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.randomness import uniform_sql
from weft.operators import heightmaps as H
from weft.sources.tables import load

SEED, ROUGHNESS, SHARE = 31, 0.55, 0.28


def _keys(spark, d) -> DataFrame:
    return load(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("map"))


def _corners(spark, d) -> DataFrame:
    """Corner heights from each supplier's balance, nation and key."""
    s = load(spark, d, "supplier")
    ends = [(0, 0, F.col("s_acctbal").cast("double") / 10000.0), (0, 1, F.col("s_nationkey") / 25.0), (1, 0, F.col("s_suppkey") % 7 / 7.0), (1, 1, -F.col("s_acctbal").cast("double") / 10000.0)]
    return s.select(F.col("s_suppkey").cast("bigint").alias("map"), F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), v.alias("v")) for y, x, v in ends))).alias("p")).select("map", "p.*")


def x01(spark, d):
    return H.diamond_square(_corners(spark, d), 3, 0.5, SEED).select("map", "y", "x", F.round("v", 9).alias("v"))


def x03(spark, d):
    return H.heightmap(_keys(spark, d), 20, 14, SEED, ROUGHNESS, SHARE).select("map", "y", "x", F.round("v", 7).alias("v"))


def x05(spark, d):
    """Maps of as many cells as a supplier's key and nation say, with a region for each of its parts' lines."""
    s = load(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("map"), (F.col("s_suppkey") % 50 + 10).cast("int").alias("width"), (F.col("s_nationkey") + 5).cast("int").alias("height"))
    lines = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("bigint").alias("map")).agg(F.count("*").alias("regions"))
    return H.border_points(s.join(lines, "map", "left").withColumn("regions", F.coalesce("regions", F.lit(0)))).select("map", "k", "y", "x")


def x06(spark, d):
    out = H.sampled(_keys(spark, d), 6, 6, 4, SEED, ROUGHNESS, SHARE, regions=6, rounds=1)
    return out.select("map", "ty", "tx", F.round("mean", 6).alias("mean"), F.round("centre", 6).alias("centre"))


def x12(spark, d):
    return H.rivers(H.materialise(H.heightmap(_keys(spark, d), 32, 32, SEED, ROUGHNESS, SHARE)), 32, 32).select("map", "river", "y", "x")


def _noise(scale: float) -> str:
    return f"{scale!r}::DOUBLE * sqrt(-2.0::DOUBLE * ln(1 - {uniform_sql(SEED, 'map', 'y', 'x')})) * cos({2 * math.pi!r}::DOUBLE * {uniform_sql(SEED + 1, 'map', 'y', 'x')})"


def _fractal(power: int, roughness: float, corners: str | None = None) -> str:
    """CTEs up to raw, the normalised map, each level unrolled; with no corners the border lies at -2 * roughness."""
    last, scale = 1 << power, 1.0
    out = "ks AS (SELECT s_suppkey::BIGINT AS map FROM supplier), "
    rim = corners is None
    if rim:
        out += f"rim AS (SELECT map, y, x, {-2 * roughness!r}::DOUBLE AS v FROM ks, range({last + 1}) a(y), range({last + 1}) b(x) WHERE y IN (0, {last}) OR x IN (0, {last})), k0 AS (SELECT * FROM rim WHERE y % {last} = 0 AND x % {last} = 0), "
    else:
        out += f"k0 AS ({corners.format(last=last)}), "
    half = last // 2
    for k in range(power):
        step = 2 * half
        out += f"""c{k} AS MATERIALIZED (SELECT map, y, x, a + {_noise(scale)} AS v FROM (SELECT map, y, x, avg(v) AS a FROM (SELECT ks.map, cy AS y, cx AS x, n.v FROM ks, range({half}, {last}, {step}) a(cy), range({half}, {last}, {step}) b(cx), (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) o(dy, dx) JOIN k{k} n ON n.map = ks.map AND n.y = cy + dy * {half} AND n.x = cx + dx * {half}) GROUP BY ALL)),
b{k} AS (FROM k{k} UNION ALL FROM c{k}),
e{k} AS MATERIALIZED (SELECT map, y, x, a + {_noise(scale)} AS v FROM (SELECT map, y, x, avg(v) AS a FROM (SELECT ks.map, cy AS y, cx AS x, n.v FROM ks, range(0, {last + 1}, {half}) a(cy), range(0, {last + 1}, {half}) b(cx), (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx) JOIN b{k} n ON n.map = ks.map AND n.y = cy + dy * {half} AND n.x = cx + dx * {half}
  WHERE ((cy + cx) // {half}) % 2 = 1{f' AND cy NOT IN (0, {last}) AND cx NOT IN (0, {last})' if rim else ''}) GROUP BY ALL)),
k{k + 1} AS MATERIALIZED (FROM b{k} UNION ALL FROM e{k}{f' UNION ALL FROM rim WHERE y % {half} = 0 AND x % {half} = 0 AND (y % {step} <> 0 OR x % {step} <> 0)' if rim else ''}),
"""
        half, scale = half // 2, scale * roughness
    return out + f"raw AS MATERIALIZED ({_flat(f'k{power}')})"


def _flat(t: str) -> str:
    return f"SELECT map, y, x, (v - min(v) OVER (PARTITION BY map)) / CASE WHEN max(v) OVER (PARTITION BY map) = min(v) OVER (PARTITION BY map) THEN 1.0::DOUBLE ELSE max(v) OVER (PARTITION BY map) - min(v) OVER (PARTITION BY map) END AS v FROM {t}"


def _heightmap(width: int, height: int) -> str:
    power = max(5, (max(width, height) - 1).bit_length())
    size = (1 << power) + 1
    return _fractal(power, ROUGHNESS) + f""",
gam AS (SELECT map, least(greatest(ln({H.WATER!r}::DOUBLE) / ln(v), 0.1), 10.0) AS gamma FROM (SELECT map, v, row_number() OVER (PARTITION BY map ORDER BY v) AS r, count(*) OVER (PARTITION BY map) AS n FROM raw WHERE v > 0) WHERE r = ceil(n * {SHARE!r}::DOUBLE)),
wet AS MATERIALIZED (SELECT map, y, x, pow(v, gamma) AS v FROM raw JOIN gam USING (map)),
ask AS (SELECT map, ty, tx, ty::DOUBLE / {height} * {size - 1} AS fy, tx::DOUBLE / {width} * {size - 1} AS fx FROM ks, range({height}) a(ty), range({width}) b(tx)),
smp AS (SELECT ask.map, ty AS y, tx AS x, sum((CASE WHEN dy = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE WHEN dx = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) * v) AS v
  FROM ask, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx) JOIN wet w ON w.map = ask.map AND w.y = least(floor(fy)::INT + dy, {size - 1}) AND w.x = least(floor(fx)::INT + dx, {size - 1}) GROUP BY ALL),
hm AS MATERIALIZED ({_flat('smp')})"""


def _sunk(t: str, w: int, h: int) -> str:
    low, margin = H.WATER * 0.25, max(1.0, min(w, h) * 0.12)
    return f"SELECT map, y, x, {low!r}::DOUBLE + (v - {low!r}::DOUBLE) * (t * t * (3 - 2 * t)) AS v FROM (SELECT *, greatest(least(least(y, x, {h - 1} - y, {w - 1} - x) / {margin!r}::DOUBLE, 1.0), 0.0) AS t FROM {t})"


def _blended(w: int, h: int, regions: int, rounds: int) -> str:
    spacing = max(2, int(max(w, h) / max(8, math.sqrt(regions))))
    rim = [p for x in range(0, w, spacing) for p in ((0, x), (h - 1, x))] + [p for y in range(0, h, spacing) for p in ((y, 0), (y, w - 1))] + [(0, 0), (0, w - 1), (h - 1, 0), (h - 1, w - 1)]
    out = f""", f0 AS MATERIALIZED ({_sunk('hm', w, h)}),
s0 AS MATERIALIZED (SELECT map, k, {uniform_sql(SEED + 7, 'map', 'k')} * {h} AS sy, {uniform_sql(SEED + 8, 'map', 'k')} * {w} AS sx FROM ks, range({regions}) r(k) UNION ALL SELECT map, k, y::DOUBLE, x::DOUBLE FROM ks, (VALUES {', '.join(f'({regions + k}, {y}, {x})' for k, (y, x) in enumerate(rim))}) p(k, y, x)),
"""
    for r in range(rounds + 1):
        out += f"n{r} AS MATERIALIZED (SELECT f.map, y, x, v, k FROM f0 f JOIN s{r} s ON s.map = f.map QUALIFY row_number() OVER (PARTITION BY f.map, y, x ORDER BY (y - sy) * (y - sy) + (x - sx) * (x - sx), k) = 1),\n"
        if r < rounds:
            out += f"m{r} AS (SELECT map, k, avg(y) AS my, avg(x) AS mx FROM n{r} GROUP BY ALL), s{r + 1} AS MATERIALIZED (SELECT s.map, s.k, CASE WHEN s.k < {regions} THEN coalesce(my, sy) ELSE sy END AS sy, CASE WHEN s.k < {regions} THEN coalesce(mx, sx) ELSE sx END AS sx FROM s{r} s LEFT JOIN m{r} m ON m.map = s.map AND m.k = s.k),\n"
    return out + f"bl AS (SELECT map, y, x, 0.82::DOUBLE * avg(v) OVER (PARTITION BY map, k) + 0.18::DOUBLE * v AS v FROM n{rounds}), bn AS ({_flat('bl')}), fin AS ({_sunk('bn', w, h)})"


_CORNERS = "SELECT s_suppkey::BIGINT AS map, cy * {last} AS y, cx * {last} AS x, CASE WHEN cy = 0 AND cx = 0 THEN s_acctbal::DOUBLE / 10000 WHEN cy = 0 THEN s_nationkey::DOUBLE / 25 WHEN cx = 0 THEN (s_suppkey % 7)::DOUBLE / 7 ELSE -s_acctbal::DOUBLE / 10000 END AS v FROM supplier, range(2) a(cy), range(2) b(cx)"
_POINTS = """WITH s AS (SELECT s_suppkey::BIGINT AS map, (s_suppkey % 50 + 10)::INT AS w, (s_nationkey + 5)::INT AS h, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n FROM supplier),
g AS (SELECT *, greatest(2, floor(greatest(w, h) / greatest(8.0::DOUBLE, sqrt(n)))::INT) AS gap FROM s),
p AS (SELECT map, 0 AS part, x AS i, side, side * (h - 1) AS y, x FROM g, unnest(range(0, w, gap)) u(x), range(2) t(side)
  UNION ALL SELECT map, 1, y, side, y, side * (w - 1) FROM g, unnest(range(0, h, gap)) u(y), range(2) t(side)
  UNION ALL SELECT map, 2, a, b, a * (h - 1), b * (w - 1) FROM g, range(2) t(a), range(2) v(b))
SELECT map, (row_number() OVER (PARTITION BY map ORDER BY part, i, side) - 1)::INT AS k, y::DOUBLE AS y, x::DOUBLE AS x FROM p"""
#: One candidate after another, in the order of heights.
_RIVERS = f"""WITH RECURSIVE {_heightmap(32, 32)}, turn(dy, dx, place) AS (VALUES (-1, 0, 0), (0, 1, 1), (1, 0, 2), (0, -1, 3)),
low AS MATERIALIZED (SELECT a.map, a.y, a.x, a.v, b.y AS ny, b.x AS nx, b.v AS nv FROM hm a, turn JOIN hm b ON b.map = a.map AND b.y = a.y + dy AND b.x = a.x + dx QUALIFY row_number() OVER (PARTITION BY a.map, a.y, a.x ORDER BY b.v, place) = 1),
walk AS (SELECT map, y AS y0, x AS x0, v AS v0, y, x, [y * 32 + x] AS seen, false AS wet FROM hm WHERE v >= 0.62
  UNION ALL SELECT w.map, y0, x0, v0, ny, nx, list_append(seen, ny * 32 + nx), nv < 0.28 FROM walk w JOIN low l ON l.map = w.map AND l.y = w.y AND l.x = w.x WHERE NOT wet AND (nv < 0.28 OR (nv <= l.v + 0.03 AND NOT list_contains(seen, ny * 32 + nx))) AND len(seen) <= 64),
valid AS MATERIALIZED (SELECT map, y0 * 32 + x0 AS id, seen[:-2] AS cells, row_number() OVER (PARTITION BY map ORDER BY v0 DESC, y0, x0) AS place FROM walk WHERE wet AND len(seen) >= 6),
pick AS (SELECT map, 0::BIGINT AS i, 0 AS n, []::BIGINT[] AS held, false AS ok, []::BIGINT[] AS own FROM ks
  UNION ALL SELECT p.map, p.i + 1, p.n + (NOT list_contains(held, id))::INT, CASE WHEN list_contains(held, id) THEN held ELSE list_concat(held, cells) END, NOT list_contains(held, id), cells FROM pick p JOIN valid v ON v.map = p.map AND v.place = p.i + 1 WHERE p.n < 3)
SELECT map, n AS river, (c // 32)::INT AS y, (c % 32)::INT AS x FROM (SELECT map, n, unnest(own) AS c FROM pick WHERE ok)"""

_CASES = {
    "x01": (x01, f"WITH {_fractal(3, 0.5, _CORNERS)} SELECT map, y, x, round(v, 9) AS v FROM raw"),
    "x03": (x03, f"WITH {_heightmap(20, 14)} SELECT map, y, x, round(v, 7) AS v FROM hm"),
    "x05": (x05, _POINTS),
    "x06": (x06, f"WITH {_heightmap(24, 24)}{_blended(24, 24, 6, 1)} SELECT map, y // 4 AS ty, x // 4 AS tx, round(avg(v), 6) AS mean, round(max(v) FILTER (y % 4 = 2 AND x % 4 = 2), 6) AS centre FROM fin GROUP BY ALL"),
    "x12": (x12, _RIVERS),
}

QUERIES = {k: f for k, (f, _) in _CASES.items()}
SQL = {k: sql for k, (_, sql) in _CASES.items()}
