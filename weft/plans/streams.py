"""Streams, attributions, tuning and markup over the driver's tables (Z, M28-M37, F08, F14, X16 rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import markup
from weft.operators import attribution, forest
from weft.operators.storage import materialise
from weft.plans import forest_sql
from weft.sources.tables import load
from weft.streaming import chunks as C
from weft.streaming import events as S


def z01(spark, d):
    return S.folded(load(spark, d, "conversations"), "conv_id", ["turn", "role"], "text").select("conv_id", "n", F.md5("text").alias("md5"))


def z02(spark, d):
    """Daily counts by a stream that runs over the files there are."""
    out = S.run_available(S.windowed_counts(S.read_stream(spark, d, "events")))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "most")


def z05(spark, d):
    _, calls = S.distinct_calls(load(spark, d, "events"), ["user_id", "event_type"], "event_id")
    return calls


def z07(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, d, "events").select("event_id", (F.col("event_type") == F.lag("event_type").over(w)).alias("repeated"))


def s19(spark, d):
    """Turns of conversations, rendered as events, cut into chunks of 64 characters and put together again."""
    c = load(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max_by("role", F.struct("role", "text")).alias("role"), F.max_by("text", F.struct("role", "text")).alias("text"))
    chunks = C.rendered(c, "conv_id", "turn", "role", "text", 64)
    return C.events(chunks, "conv_id").select("conv_id", "n", "event", F.from_json("data", "text string")["text"].alias("text"))


def _rows(spark, d) -> DataFrame:
    line = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("s"), F.max("l_tax").alias("t"), F.max("l_extendedprice").alias("p"))
    x = F.array(*(F.col(c).cast("double") for c in ("q", "s", "t")))
    return line.select(F.col("l_orderkey").alias("key"), x.alias("x"), (F.col("p") / 100).alias("y"))


def _forest(rows: DataFrame, trees: int, depth: int, seed: int = 42) -> DataFrame:
    rows = rows.select("key", "x", "y", F.lit(1).alias("weight"))
    return forest.grow(rows, depth=depth, seed=seed, task="regression", trees=F.sequence(F.lit(0), F.lit(trees - 1)))


def m30(spark, d):
    """What each leaf of a tree adds to each order's attributions."""
    rows = _rows(spark, d)
    return attribution.leaf_contributions(rows, _forest(rows, 1, 3), "key", 3).select("key", "leaf", "feature", (F.floor(F.col("phi") * 1e4 + 0.5) / 1e4).alias("phi"))


def m32(spark, d):
    rows = materialise(_rows(spark, d))
    return attribution.forest_shap(rows, _forest(rows, 3, 3), "key", 3).select("key", "feature", (F.floor(F.col("phi") * 1e4 + 0.5) / 1e4).alias("phi"))


def m33(spark, d):
    """Predictions, and whether their attributions sum to them; both are worked out where a row is."""
    rows = materialise(_rows(spark, d))
    nodes = _forest(rows, 3, 3)
    got = forest.routed(attribution.shap_arrays(rows.select("key", "x", F.lit(0).alias("run")), nodes, 3), nodes, [(3, 3)], 3)
    explained = F.aggregate("phi", F.lit(0.0), lambda a, b: a + b)
    return got.withColumn("predicted", F.round(F.get("means", F.lit(0)), 6)).select("key", "predicted", (F.abs(F.col("predicted") - explained) < 1e-5).alias("explained"))


def f08(spark, d):
    docs = load(spark, d, "documents")
    raw = F.concat(F.lit("# Title\n\n- one **"), F.col("lang"), F.lit("**\n- two\n\n> quote\n\n"), F.col("text"))
    return docs.select("doc_id", F.md5(markup.markdown_html(raw)).alias("md5"))


def f14(spark, d):
    return load(spark, d, "documents").select("doc_id", markup.wrapped("text", 60).alias("l")).select("doc_id", F.size("l").alias("n"), F.array_max(F.transform("l", lambda x: F.length(x))).alias("widest"))


def x16(spark, d):
    """Places of the characters of wrapped part names in a fixed grid of 8 by 16."""
    p = load(spark, d, "part").select("p_partkey", F.posexplode(markup.wrapped("p_name", 10)).alias("row", "line"))
    return p.select("p_partkey", "row", F.posexplode(F.filter(F.split("line", ""), lambda x: x != "")).alias("col", "glyph")).select("p_partkey", "glyph", (F.col("col") * 8).alias("x"), (F.col("row") * 16).alias("y"))


def _broken(rows: str, width: int) -> str:
    """SQL: lines (key, para, k, line) of rows (key, text), each step of the recursion taking one line off a paragraph's rest."""
    fits = f"list_max(list_filter(range(1, {width + 1}), lambda k: rest[k + 1] = ' '))"
    return f"""WITH RECURSIVE paras AS (
  SELECT key, para, string_split(text, chr(10))[para] AS rest FROM ({rows}), unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(para)),
steps AS (
  SELECT key, para, 0 AS k, NULL::VARCHAR AS line, rest, false AS done FROM paras
  UNION ALL
  SELECT key, para, k + 1,
         CASE WHEN length(rest) <= {width} THEN rest WHEN cut IS NULL THEN rest[:{width}] ELSE rest[:cut] END,
         CASE WHEN length(rest) <= {width} THEN '' WHEN cut IS NULL THEN rest[{width + 1}:] ELSE ltrim(rest[cut + 1:], ' ') END,
         length(rest) <= {width}
  FROM (SELECT *, {fits} AS cut FROM steps WHERE NOT done)),
lines AS (SELECT key, para, k, line FROM steps WHERE k > 0)
"""


_SHAP = "WITH fo AS (SELECT l_orderkey AS key, sum(l_quantity) AS q, max(l_discount) AS s, max(l_tax) AS t, (max(l_extendedprice) / 100)::DECIMAL(18,4) AS y FROM lineitem GROUP BY 1), fv AS (SELECT key, unnest([0, 1, 2]) AS feature, unnest([q, s, t]) AS v FROM fo), fr AS (SELECT tree, key, 1 AS weight, y FROM fo, range(3) t(tree)), " + forest_sql.grown(3, task="regression")
#: Shapley values by all subsets of the three features: unknown features split by the nodes' sizes.
_SUBSETS = """, lv AS (SELECT tree, node AS leaf, mean FROM nd WHERE feature IS NULL),
step AS (SELECT lv.tree, leaf, leaf >> (k - 1) AS child, leaf >> k AS parent FROM lv, range(1, 4) c(k) WHERE leaf >> k > 0),
edge AS (SELECT step.tree, leaf, p.feature, p.threshold, child % 2 AS side, c.n / p.n AS ratio FROM step JOIN nd p ON p.tree = step.tree AND p.node = parent JOIN nd c ON c.tree = step.tree AND c.node = child),
fac AS (SELECT key, e.tree, leaf, mask, list_product(list(CASE WHEN mask & (1 << feature) > 0 THEN ((v > threshold)::INT = side)::INT::DOUBLE ELSE ratio END)) AS w FROM edge e JOIN fv USING (feature), range(8) m(mask) GROUP BY ALL),
val AS (SELECT key, fac.tree, mask, sum(w * mean) AS f FROM fac JOIN lv USING (tree, leaf) GROUP BY ALL),
phi AS (SELECT a.key, a.tree, g.feature, sum((b.f - a.f) * CASE WHEN bit_count(a.mask) = 1 THEN 1.0::DOUBLE / 6 ELSE 1.0::DOUBLE / 3 END) AS phi FROM val a, range(3) g(feature), val b WHERE a.mask & (1 << g.feature) = 0 AND b.key = a.key AND b.tree = a.tree AND b.mask = a.mask | (1 << g.feature) GROUP BY ALL)
SELECT key, feature::INT AS feature, floor(sum(phi) / 3 * 1e4 + 0.5::DOUBLE) / 1e4 AS phi FROM (FROM phi UNION ALL SELECT key, tree, -1, f FROM val WHERE mask = 0) GROUP BY ALL"""

#: The same for single leaves of the first tree: features off a leaf's path add nothing.
_LEAVES = """, lv AS (SELECT tree, node AS leaf, mean FROM nd WHERE feature IS NULL AND tree = 0),
step AS (SELECT lv.tree, leaf, leaf >> (k - 1) AS child, leaf >> k AS parent FROM lv, range(1, 4) c(k) WHERE leaf >> k > 0),
edge AS (SELECT step.tree, leaf, p.feature, p.threshold, child % 2 AS side, c.n / p.n AS ratio FROM step JOIN nd p ON p.tree = step.tree AND p.node = parent JOIN nd c ON c.tree = step.tree AND c.node = child),
fac AS (SELECT key, leaf, mask, list_product(list(CASE WHEN mask & (1 << feature) > 0 THEN ((v > threshold)::INT = side)::INT::DOUBLE ELSE ratio END)) AS w FROM edge e JOIN fv USING (feature), range(8) m(mask) GROUP BY ALL),
val AS (SELECT key, leaf, mask, w * mean AS f FROM fac JOIN lv USING (leaf))
SELECT a.key, a.leaf::BIGINT AS leaf, g.feature::INT AS feature, floor(sum((b.f - a.f) * CASE WHEN bit_count(a.mask) = 1 THEN 1.0::DOUBLE / 6 ELSE 1.0::DOUBLE / 3 END) * 1e4 + 0.5::DOUBLE) / 1e4 AS phi
FROM val a, (SELECT DISTINCT leaf, feature FROM edge) g, val b WHERE g.leaf = a.leaf AND a.mask & (1 << g.feature) = 0 AND b.key = a.key AND b.leaf = a.leaf AND b.mask = a.mask | (1 << g.feature) GROUP BY ALL"""


_CASES = {
    "s19": (s19, "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, x.role AS event, x.text AS text FROM (SELECT conv_id, turn, max({'role': role, 'text': text}) AS x FROM conversations GROUP BY ALL)"),
    "m30": (m30, _SHAP + _LEAVES),
    "z01": (z01, "SELECT conv_id, count(*) AS n, md5(string_agg(text, '' ORDER BY turn, role, text)) AS md5 FROM conversations GROUP BY 1"),
    "z02": (z02, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL"),
    "z05": (z05, "SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS run_id FROM events"),
    "z07": (z07, "SELECT event_id, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS repeated FROM events"),
    "m32": (m32, _SHAP + _SUBSETS),
    "m33": (m33, _SHAP + "SELECT key, round(avg(mean), 6) AS predicted, true AS explained FROM leaf JOIN nd USING (tree, node) GROUP BY key"),
    "f08": (f08, None),
    "f14": (f14, _broken("SELECT doc_id AS key, text FROM documents", 60) + "SELECT key AS doc_id, count(*) AS n, max(length(line)) AS widest FROM lines GROUP BY key"),
    "x16": (x16, _broken("SELECT p_partkey AS key, p_name AS text FROM part", 10) + ", r AS (SELECT key, line, row_number() OVER (PARTITION BY key ORDER BY para, k) - 1 AS row FROM lines) SELECT key AS p_partkey, line[c] AS glyph, (c - 1) * 8 AS x, row * 16 AS y FROM r, unnest(range(1, length(line) + 1)) AS u(c)"),
}

QUERIES = {k: f for k, (f, _) in _CASES.items()}
SQL = {k: sql for k, (_, sql) in _CASES.items() if sql}
