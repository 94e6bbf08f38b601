"""Array operators over the quantities of each order's lines (A rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import arrays as A
from weft.sources.tables import load


def order_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order: a, its quantities in line order, and b, its line numbers (both double)."""
    line = load(spark, sf_dir, "lineitem")
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey")))
    return line.groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.transform("r", lambda x: x["l_quantity"]).alias("a"), F.transform("r", lambda x: x["l_linenumber"].cast("double")).alias("b"))


ORDER_SQL = """WITH q AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity, l_partkey) AS a, list(l_linenumber::DOUBLE ORDER BY l_linenumber, l_quantity, l_partkey) AS b FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, """


def whole(a: Column) -> Column:
    """An array of whole numbers as text."""
    return F.array_join(F.transform(a, lambda x: x.cast("bigint").cast("string")), ",")


def _w(sql: str) -> str:
    return f"array_to_string(list_transform({sql}, lambda z: z::BIGINT), ',')"


def _pairs(f: str) -> str:
    return f"list_transform(range(1, len(a) + 1), lambda i: {f.replace('x', 'a[i]').replace('y', 'b[i]')})"


_CASES: dict[str, tuple[Callable[[], Column], str]] = {
    "a01": (lambda: whole(F.array(A.item("a", 0), F.lit(2.0), A.item("b", 0))), _w("[a[1], 2.0, b[1]]")),
    "a02": (lambda: whole(A.zeros(F.size("a"))), _w("list_transform(a, lambda x: 0)")),
    "a03": (lambda: whole(A.arange(0, F.element_at("a", 1), 3)), _w("list_transform(range(0, a[1]::BIGINT, 3), lambda x: x)")),
    "a04": (lambda: whole(F.flatten(A.eye(F.size("a"), F.size("a") + 1))), _w("flatten(list_transform(range(0, len(a)), lambda i: list_transform(range(0, len(a) + 1), lambda j: CASE WHEN i = j THEN 1 ELSE 0 END)))")),
    "a05": (lambda: A.item("a", -1), "a[len(a)]"),
    "a06": (lambda: whole(A.sliced("a", 1, 6, 2)), _w("list_transform(list_filter(range(1, len(a) + 1), lambda i: i >= 2 AND i <= 6 AND i % 2 = 0), lambda i: a[i])")),
    "a07": (lambda: F.size(F.array("a")).cast("long") * 100 + F.size(A.item(F.array("a"), 0)), "100 + len(a)"),
    "a08": (lambda: whole(A.assigned("a", 0, F.lit(-7.9).cast("int"))), _w("list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = 1 THEN -7 ELSE a[i] END)")),
    "a09": (lambda: whole(A.zipped("a", "b", lambda x, y: x + y)), _w(_pairs("x + y"))),
    "a10": (lambda: whole(A.scaled("a", 100.0, lambda x, s: s - x)), _w("list_transform(a, lambda x: 100 - x)")),
    "a11": (lambda: whole(A.zipped("a", "b", lambda x, y: x * y)), _w(_pairs("x * y"))),
    "a12": (lambda: F.round(A.total(A.zipped("a", "b", lambda x, y: x / y)), 6), "round(list_sum(" + _pairs("x / y") + "), 6)"),
    "a13": (lambda: whole(A.scaled("a", -4.0, A.floor_divide)), _w("list_transform(a, lambda x: floor(x / -4.0))")),
    "a14": (lambda: whole(A.scaled("a", -4.0, A.modulo)), _w("list_transform(a, lambda x: x - (-4.0) * floor(x / -4.0))")),
    "a15": (lambda: whole(A.scaled("a", 2.0, lambda x, s: F.pow(x, s))), _w("list_transform(a, lambda x: pow(x, 2))")),
    "a16": (lambda: whole(A.scaled(A.zipped("a", "b", lambda x, y: x - y), 3.0, lambda x, s: x * s)), _w(_pairs("(x - y) * 3"))),
    "a17": (lambda: F.size(F.filter(A.zipped("a", "b", lambda x, y: x == y), lambda x: x)).cast("long"), "len(list_filter(" + _pairs("x = y") + ", lambda z: z))"),
    "a18": (lambda: A.total("a"), "list_sum(a)"),
    "a19": (lambda: F.round(F.log(A.product("a")), 6), "round(ln(list_reduce(a, lambda x, y: x * y)), 6)"),
    "a20": (lambda: F.round(A.mean("a"), 9), "round(list_sum(a) / len(a), 9)"),
    "a21": (lambda: F.array_max("a") * 1000 + F.array_min("a"), "list_max(a) * 1000 + list_min(a)"),
    "a22": (lambda: A.peak_to_peak("a"), "list_max(a) - list_min(a)"),
    "a23": (lambda: A.argmax("a") * 1000 + A.argmin("a"), "(list_position(a, list_max(a)) - 1) * 1000 + list_position(a, list_min(a)) - 1"),
    "a24": (lambda: F.round(A.variance("a"), 6), "round(list_var_pop(a), 6)"),
    "a25": (lambda: F.forall("a", lambda x: x != 1) & F.exists("a", lambda x: x > 25), "len(list_filter(a, lambda x: x = 1)) = 0 AND len(list_filter(a, lambda x: x > 25)) > 0"),
    "a27": (lambda: whole(F.transform("a", lambda x: F.lit(5.0))), _w("list_transform(a, lambda x: 5)")),
    "a28": (lambda: whole(F.flatten(F.array("a", "b"))), _w("flatten([a, b])")),
    "a29": (lambda: whole(F.transform(A.reshaped(F.concat("a", "b"), 2, F.size("a")), lambda r: A.total(r))), _w("[list_sum(a), list_sum(b)]")),
    "a30": (lambda: whole(F.flatten(A.transposed(F.array("a", "b")))), _w("flatten(list_transform(range(1, len(a) + 1), lambda i: [a[i], b[i]]))")),
    "a31": (lambda: whole(F.transform(A.scaled("a", -4.0, lambda x, s: x / s), lambda x: x.cast("int"))), _w("list_transform(a, lambda x: trunc(x / -4.0))")),
    "a33": (lambda: F.when(F.size("a") == 1, A.item("a", 0).cast("int")), "CASE WHEN len(a) = 1 THEN a[1]::INT END"),
    "a35": (lambda: F.size("a").cast("long") * 8, "(len(a) * 8)::BIGINT"),
    "a39": (lambda: whole(F.flatten(F.array(F.slice("a", 1, 2), F.slice("b", 1, 2)))), _w("flatten([a[1:2], b[1:2]])")),
    "a40": (lambda: F.size("a").cast("long"), "len(a)::BIGINT"),
    "a50": (lambda: whole(A.unique("a")), _w("list_sort(list_distinct(a))")),
    "a51": (lambda: whole(A.bincount("b", 4)), _w("list_transform(range(0, greatest(list_max(b)::BIGINT + 1, 4)), lambda k: len(list_filter(b, lambda x: x::BIGINT = k)))")),
}


def _query(value: Callable[[], Column]):
    return lambda spark, sf_dir: order_arrays(spark, sf_dir).select("l_orderkey", value().alias("value"))


def a36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat iteration: one row for each element with its place."""
    return order_arrays(spark, sf_dir).select("l_orderkey", F.posexplode(F.flatten(F.array("a", "b"))).alias("pos", "value"))


QUERIES = {k: _query(v) for k, (v, _) in _CASES.items()} | {"a36": a36}
SQL = {k: ORDER_SQL + sql + " AS value FROM q" for k, (_, sql) in _CASES.items()} | {"a36": ORDER_SQL.removesuffix("SELECT l_orderkey, ") + "SELECT l_orderkey, (i - 1)::INT AS pos, v[i] AS value FROM (SELECT l_orderkey, flatten([a, b]) AS v FROM q), unnest(range(1, len(v) + 1)) AS u(i)"}
