"""Online forests over orders (M18, M19 and Z04 rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.randomness import uniform_sql
from weft.operators import online
from weft.operators.storage import shared_dir
from weft.sources.tables import load

TREES, CLASSES, DEPTH, SEED, LIFETIME = 3, 4, 8, 18, 4.0
_FEATURES = 2


def _orders(spark, d) -> DataFrame:
    """Price and day of orders, scaled; the target is the first digit of the priority."""
    o = load(spark, d, "orders")
    x = F.array(F.col("o_totalprice").cast("double") / 500000.0, F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")) / 2500.0)
    return o.select(F.col("o_orderkey").cast("bigint").alias("key"), x.alias("x"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"))


def _classed(spark, d) -> DataFrame:
    """Targets as ones by class 0 to 3; a priority beyond them counts as class 0, as labels do that a forest doesn't know."""
    c = F.when(F.col("level").between(1, CLASSES), F.col("level") - 1).otherwise(0)
    return _orders(spark, d).withColumn("y", F.array(*((c == k).cast("double") for k in range(CLASSES)))).drop("level")


def _how(trees: int, width: int) -> dict:
    return {"trees": trees, "features": _FEATURES, "width": width, "seed": SEED, "lifetime": LIFETIME, "depth": DEPTH}


def _told(nodes: DataFrame) -> DataFrame:
    nine = lambda c: F.round(c, 9)
    return nodes.select("tree", "node", "feature", nine(F.col("threshold")).alias("threshold"), nine(F.col("tau")).alias("tau"), "n", *(nine(F.get(s, F.lit(k))).alias(f"{s[:2]}{k}") for s in ("los", "his") for k in range(_FEATURES)), "sums")


def m18(spark, d):
    """One regression tree after all orders, in the order of their keys."""
    rows = _orders(spark, d).select("key", "x", F.when(F.col("level").isNotNull(), F.array(F.col("level").cast("double"))).alias("y"))
    nodes = online.fold(online.roots(spark, 1, _FEATURES, 1), rows, **_how(1, 1))
    return _told(nodes).withColumn("mean", F.when(F.col("n") > 0, F.round(F.get("sums", F.lit(0)) / F.col("n"), 9))).drop("sums", "tree")


def m19(spark, d):
    """Class shares of each order by a forest of trees that has taken all orders in."""
    rows = _classed(spark, d)
    nodes = online.fold(online.roots(spark, TREES, _FEATURES, CLASSES), rows, **_how(TREES, CLASSES))
    shares = online.class_shares(rows, nodes, TREES, CLASSES)
    return shares.select("key", *(F.round(F.get("shares", F.lit(k)), 6).alias(f"p{k}") for k in range(CLASSES)))


def z04(spark, d):
    """The forest of m19 as a stream: three runs over files that arrive one after another, each from where the last one stopped."""
    rows = _classed(spark, d)
    root = f"{shared_dir(spark)}/weft-online-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    start = online.roots(spark, TREES, _FEATURES, CLASSES)
    last = None
    for k in range(3 if low is not None else 0):
        part = rows.where(F.floor((F.col("key") - low) * 3 / (high - low + 1)) == k)
        part.write.mode("append").parquet(f"{root}/arrived")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/arrived")
        query = stream.writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(lambda b, i: online.fold_stream(b, i, root, start, **_how(TREES, CLASSES))).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.lastProgress:
            last = query.lastProgress["batchId"]
    nodes = start if last is None else spark.read.schema(start.schema).parquet(f"{root}/nodes-{last:06d}")
    return _told(nodes).select("*", *(F.get("sums", F.lit(k)).cast("bigint").alias(f"c{k}") for k in range(CLASSES))).drop("sums")


def _grown(trees: int, target: str) -> str:
    """CTEs up to nd, the nodes of all levels, each unrolled: w boxes before a row, c rows that would split, s first of them."""
    u = [uniform_sql(SEED + k, "tree", "node", "key") for k in range(3)]
    window = "(PARTITION BY a.tree, a.node ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    out = f"""o AS (SELECT o_orderkey AS key, o_totalprice::DOUBLE / 500000.0::DOUBLE AS x0, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE / 2500.0::DOUBLE AS x1, substr(o_orderpriority, 1, 1)::INT AS level FROM orders),
a0 AS (SELECT tree::INT AS tree, 1::BIGINT AS node, key, x0, x1, {target} FROM o, range({trees}) t(tree)),
l0 AS (SELECT tree::INT AS tree, 1::BIGINT AS node, 0.0::DOUBLE AS tau, 0::BIGINT AS n, {', '.join(f'0.0::DOUBLE AS y{k}' for k in range(target.count(' AS y')))}, NULL::DOUBLE AS lo0, NULL::DOUBLE AS hi0, NULL::DOUBLE AS lo1, NULL::DOUBLE AS hi1 FROM range({trees}) t(tree)),
"""
    ys = [f"y{k}" for k in range(target.count(" AS y"))]
    for k in range(DEPTH + 1):
        step = lambda i: f"(CASE WHEN lo{i} IS NULL THEN 0.0::DOUBLE ELSE greatest(lo{i} - x{i}, 0.0::DOUBLE) + greatest(x{i} - hi{i}, 0.0::DOUBLE) END)"
        out += f"""w{k} AS (SELECT a.tree, a.node, key, x0, x1, tau, {', '.join(f"{f}(l.{s}{i}, {g}(x{i}) OVER {window}) AS {s}{i}" for s, f, g in (('lo', 'least', 'min'), ('hi', 'greatest', 'max')) for i in (0, 1))} FROM a{k} a JOIN l{k} l ON a.tree = l.tree AND a.node = l.node),
e{k} AS (SELECT *, {step(0)} AS s0, {step(0)} + {step(1)} AS total FROM w{k}),
c{k} AS (SELECT *, tau - ln(1 - {u[0]}) / total AS cut, ({u[1]} * total > s0)::INT AS feature FROM e{k} WHERE total > 1e-15::DOUBLE AND {'tau - ln(1 - ' + u[0] + ') / total < ' + str(LIFETIME) + '::DOUBLE' if k < DEPTH else 'false'}),
f{k} AS (SELECT * FROM c{k} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY key) = 1),
g{k} AS (SELECT *, CASE feature WHEN 0 THEN x0 ELSE x1 END AS v, CASE feature WHEN 0 THEN lo0 ELSE lo1 END AS lo, CASE feature WHEN 0 THEN hi0 ELSE hi1 END AS hi FROM f{k}),
s{k} AS (SELECT tree, node, key AS at, feature, cut, v < lo AS below, CASE WHEN v < lo THEN v + {u[2]} * (lo - v) ELSE hi + {u[2]} * (v - hi) END AS threshold, least(lo0, x0) AS lo0, greatest(hi0, x0) AS hi0, least(lo1, x1) AS lo1, greatest(hi1, x1) AS hi1 FROM g{k}),
m{k} AS (SELECT l.tree, l.node, l.n + count(key) AS n, {', '.join(f'l.{y} + coalesce(sum(a.{y}), 0) AS {y}' for y in ys)}, least(l.lo0, min(x0)) AS lo0, greatest(l.hi0, max(x0)) AS hi0, least(l.lo1, min(x1)) AS lo1, greatest(l.hi1, max(x1)) AS hi1,
  l.n + count(key) FILTER (key <= s.at) AS bn, {', '.join(f'l.{y} + coalesce(sum(a.{y}) FILTER (key <= s.at), 0) AS b{y}' for y in ys)}
  FROM l{k} l LEFT JOIN a{k} a ON a.tree = l.tree AND a.node = l.node LEFT JOIN s{k} s ON s.tree = l.tree AND s.node = l.node GROUP BY l.tree, l.node, l.n, {', '.join('l.' + y for y in ys)}, l.lo0, l.hi0, l.lo1, l.hi1),
n{k} AS (SELECT m.tree, m.node, {k} AS depth, feature, threshold, coalesce(cut, tau) AS tau, m.n, {', '.join('m.' + y for y in ys)}, m.lo0, m.hi0, m.lo1, m.hi1 FROM m{k} m JOIN l{k} l ON m.tree = l.tree AND m.node = l.node LEFT JOIN s{k} s ON s.tree = m.tree AND s.node = m.node),
"""
        if k < DEPTH:
            keep = lambda c, otherwise: f"CASE WHEN (side = 1) = below THEN {c} ELSE {otherwise} END"
            out += f"""l{k + 1} AS (SELECT s.tree, s.node * 2 + side AS node, cut AS tau, {keep('bn', '0')} AS n, {', '.join(f"{keep('b' + y, '0.0::DOUBLE')} AS {y}" for y in ys)}, {', '.join(f"{keep('s.' + b, 'NULL')} AS {b}" for b in ('lo0', 'hi0', 'lo1', 'hi1'))} FROM s{k} s JOIN m{k} m ON s.tree = m.tree AND s.node = m.node, range(2) c(side)),
a{k + 1} AS (SELECT a.tree, a.node * 2 + (CASE feature WHEN 0 THEN a.x0 ELSE a.x1 END > threshold)::INT AS node, key, x0, x1, {', '.join(ys)} FROM a{k} a JOIN s{k} s ON a.tree = s.tree AND a.node = s.node WHERE key > s.at),
"""
    return out + "nd AS (" + " UNION ALL ".join(f"FROM n{k}" for k in range(DEPTH + 1)) + ")\n"


_TOLD = "node, feature, round(threshold, 9) AS threshold, round(tau, 9) AS tau, n, round(lo0, 9) AS lo0, round(lo1, 9) AS lo1, round(hi0, 9) AS hi0, round(hi1, 9) AS hi1"
_ONES = ", ".join(f"({'level NOT BETWEEN 1 AND 4 OR ' if k == 0 else ''}level = {k + 1})::INT::DOUBLE AS y{k}" for k in range(CLASSES))
_FOREST = _grown(TREES, _ONES)
_LEAF = f"""reach AS (
  SELECT tree::INT AS tree, 1::BIGINT AS node, key, x0, x1 FROM o, range({TREES}) t(tree)
  UNION ALL SELECT r.tree, r.node * 2 + (CASE feature WHEN 0 THEN r.x0 ELSE r.x1 END > threshold)::INT, key, r.x0, r.x1 FROM reach r JOIN nd ON nd.tree = r.tree AND nd.node = r.node AND feature IS NOT NULL),
leaf AS (SELECT key, {', '.join(f'CASE WHEN n > 0 THEN y{k} / n ELSE 1.0::DOUBLE / {CLASSES} END AS q{k}' for k in range(CLASSES))} FROM reach r JOIN nd ON nd.tree = r.tree AND nd.node = r.node AND feature IS NULL)
SELECT key, {', '.join(f'round(avg(q{k}), 6) AS p{k}' for k in range(CLASSES))} FROM leaf GROUP BY key"""

_CASES = {
    "m18": (m18, f"WITH {_grown(1, 'level::DOUBLE AS y0')} SELECT {_TOLD}, CASE WHEN n > 0 THEN round(y0 / n, 9) END AS mean FROM nd"),
    "m19": (m19, f"WITH RECURSIVE {_FOREST}, {_LEAF}"),
    "z04": (z04, f"WITH {_FOREST} SELECT tree, {_TOLD}, {', '.join(f'y{k}::BIGINT AS c{k}' for k in range(CLASSES))} FROM nd"),
}

QUERIES = {k: f for k, (f, _) in _CASES.items()}
SQL = {k: sql for k, (_, sql) in _CASES.items()}
