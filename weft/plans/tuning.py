"""Choosing among forests over the driver's tables (S28, M37, M42 rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.randomness import uniform_sql
from weft.operators.storage import materialise
from weft.operators.tuning import Halving, benchmarked
from weft.plans import forest_sql
from weft.sources.tables import load

SIZES = [(1, 1), (1, 3), (3, 1), (3, 3)]
SEEDS = [0, 1]
METHODS = ["best", "random"]


def _orders(spark, d) -> DataFrame:
    line = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("s"), F.max("l_tax").alias("t"), F.max("l_extendedprice").alias("p"))
    return line.select(F.col("l_orderkey").alias("key"), F.array(*(F.col(c).cast("double") for c in ("q", "s", "t"))).alias("x"), (F.col("p") / 100).alias("y"))


def _customers(spark, d) -> DataFrame:
    """Whether a customer has an order that is filled, by number of orders, balance and nation."""
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max(F.col("o_orderstatus") == "F").alias("filled"))
    c = load(spark, d, "customer").join(o, "c_custkey")
    return c.select(F.col("c_custkey").alias("key"), F.array(*(F.col(k).cast("double") for k in ("n", "c_acctbal", "c_nationkey"))).alias("x"), F.col("filled").cast("double").alias("y"))


def s28(spark, d):
    """Mean scores of two kinds of forest in four sizes on two datasets, over two seeds."""
    sets = None
    for k, (rows, binary) in enumerate([(_orders(spark, d), False), (_customers(spark, d), True)]):
        own = rows.select(F.lit(k).alias("dataset"), (F.col("key") * 2 + k).alias("key"), "x", F.col("y").cast("double").alias("y"), F.lit(binary).alias("binary"))
        sets = own if sets is None else sets.unionByName(own)
    out = benchmarked(sets, METHODS, SIZES, SEEDS)
    return out.select("dataset", "method", "trees", "depth", "runs", *(F.round(c, 4).alias(c) for c in ("mse", "accuracy", "auc")))


def m37(spark, d):
    """Successive halving over depth and trees: scores on held-out rows; the better half gets twice the rows."""
    told = [(a, t, k, round(mse, 4), place) for a, t, k, mse, place in Halving(SIZES).rungs(_orders(spark, d))]
    return spark.createDataFrame(told, "share double, trees int, depth int, mse double, place int")


def m42(spark, d):
    """Predictions of the best size, grown again on all orders."""
    rows = materialise(_orders(spark, d))
    return Halving(SIZES).fit(rows).predict(rows)


_ORDERS = "SELECT l_orderkey AS key, [sum(l_quantity)::DOUBLE, max(l_discount)::DOUBLE, max(l_tax)::DOUBLE] AS x, max(l_extendedprice) / 100 AS y FROM lineitem GROUP BY 1"
_CUSTOMERS = "SELECT c_custkey AS key, [n::DOUBLE, c_acctbal::DOUBLE, c_nationkey::DOUBLE] AS x, filled::DOUBLE AS y FROM customer JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, max((o_orderstatus = 'F')::INT) AS filled FROM orders GROUP BY 1) USING (c_custkey)"
_FEATURES = "fv AS (SELECT key, f.i::INT AS feature, x[f.i + 1] AS v FROM fo, range(3) f(i)),\n"
#: Rows (tree, key, trees, depth, mean): the node of a size is the deepest on a row's way within its depth.
_SIZES = "sz AS (FROM (VALUES " + ", ".join(map(str, SIZES)) + ") v(trees, depth)),\nway AS (SELECT r.tree, key, sz.trees, sz.depth, arg_max(nd.mean, r.depth) AS mean FROM r JOIN nd USING (tree, node), sz WHERE r.depth <= sz.depth AND r.tree % 3 < sz.trees GROUP BY ALL)\n"


def _run(method: str) -> str:
    """SQL: scores of each run of a method; the area by mean ranks."""
    return f"""(WITH fr AS (SELECT run * 3 + t AS tree, key, learn::INT AS weight, y::DECIMAL(18,4) AS y FROM ev, range(3) c(t)), {forest_sql.grown(3, split=method, task="regression")},
{_SIZES}, pr AS (SELECT run, way.key, two, trees, depth, y, round(avg(mean), 6) AS p FROM way JOIN ev ON way.key = ev.key AND way.tree // 3 = run WHERE NOT learn GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY run, trees, depth ORDER BY p) + (count(*) OVER (PARTITION BY run, trees, depth, p) - 1) / 2 AS mid FROM pr)
SELECT run, '{method}' AS method, trees, depth, avg((p - y) ** 2) AS mse, CASE WHEN any_value(two) THEN avg(((p >= 0.5) = (y >= 0.5))::INT) END AS accuracy,
  CASE WHEN any_value(two) AND sum(y) > 0 AND sum(y) < count(*) THEN (sum(mid) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END AS auc FROM rk GROUP BY run, trees, depth)"""


_S28 = f"""WITH fo AS (SELECT 0 AS dataset, key * 2 AS key, x, y::DOUBLE AS y, false AS two FROM ({_ORDERS}) UNION ALL SELECT 1, key * 2 + 1, x, y, true FROM ({_CUSTOMERS})),
ev AS (SELECT dataset * 2 + seed AS run, key, y, two, {uniform_sql(28, 'seed', 'key')} < 0.75 AS learn FROM fo, range(2) s(seed)),
{_FEATURES} al AS ({' UNION ALL '.join(map(_run, METHODS))})
SELECT (run // 2)::INT AS dataset, method, trees, depth, count(*) AS runs, round(avg(mse), 4) AS mse, round(avg(accuracy), 4) AS accuracy, round(avg(auc), 4) AS auc FROM al GROUP BY ALL"""


def _rung(k: int, share: float, before: str | None) -> str:
    """SQL: CTE q{k}, places of the sizes that are left."""
    left = f"WHERE (trees, depth) IN (SELECT (trees, depth) FROM {before} WHERE place <= (SELECT greatest(1, count(*) // 2) FROM {before}))" if before else ""
    return f"""q{k} AS (WITH fr AS (SELECT t AS tree, key, (u >= 0.25 AND u < 0.25 + 0.75 * {share})::INT AS weight, y FROM un, range(3) c(t) WHERE u < 0.25 + 0.75 * {share}), {forest_sql.grown(3, task="regression")},
{_SIZES}, pr AS (SELECT key, trees, depth, round(avg(mean), 6) AS p FROM way GROUP BY ALL)
SELECT {share}::DOUBLE AS share, trees, depth, mse, row_number() OVER (ORDER BY mse, trees, depth)::INT AS place FROM (SELECT trees, depth, avg((p - y) ** 2) AS mse FROM pr JOIN un USING (key) WHERE u < 0.25 GROUP BY ALL) {left})"""


_RUNGS = f"WITH fo AS ({_ORDERS}), un AS (SELECT key, y, {uniform_sql(37, 'key')} AS u FROM fo), {_FEATURES}" + ",\n".join([_rung(1, 0.25, None), _rung(2, 0.5, "q1"), _rung(3, 1.0, "q2")])
_M37 = _RUNGS + "\nSELECT share, trees, depth, round(mse, 4) AS mse, place FROM (FROM q1 UNION ALL FROM q2 UNION ALL FROM q3)"
_M42 = _RUNGS + f""", fr AS (SELECT t AS tree, key, 1 AS weight, y FROM fo, range(3) c(t)), {forest_sql.grown(3, task="regression")}, {_SIZES}
SELECT key, round(avg(mean), 6) AS predicted FROM way WHERE (trees, depth) IN (SELECT (trees, depth) FROM q3 WHERE place = 1) GROUP BY key"""

_CASES = {"s28": (s28, _S28), "m37": (m37, _M37), "m42": (m42, _M42)}

QUERIES = {k: f for k, (f, _) in _CASES.items()}
SQL = {k: sql for k, (_, sql) in _CASES.items()}
