"""N-gram models, sampling and grids over the driver's tables (L, P, X, G rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.randomness import uniform, uniform_sql
from weft.operators import grids as G
from weft.operators import heightmaps as H
from weft.operators import ngrams as N
from weft.operators import sampling as P
from weft.sources.tables import load

D = 0.1


def _sentences(spark, d) -> DataFrame:
    c = load(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), N.words_of(F.col("text")).alias("words"))


def _benchmark(spark, d) -> DataFrame:
    return load(spark, d, "benchmark").select(F.col("item_id").alias("id"), N.words_of(F.col("text")).alias("words"))


_S = "sent AS (SELECT conv_id * 1000 + turn AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations), bsent AS (SELECT item_id AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM benchmark)"
_N = "uni AS (SELECT ws[i] AS w, count(*) AS c FROM sent, unnest(range(1, len(ws) + 1)) AS u(i) GROUP BY ALL), bi AS (SELECT ws[i] AS a, ws[i + 1] AS w, count(*) AS c FROM sent, unnest(range(1, len(ws))) AS u(i) GROUP BY ALL), tri AS (SELECT ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS w, count(*) AS c FROM sent, unnest(range(1, len(ws) - 1)) AS u(i) GROUP BY ALL)"
_L = f"WITH {_S}, {_N} "
_SCORE = _L + f""", tok AS (SELECT id, i AS pos, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS b, CASE WHEN i > 2 THEN ws[i - 2] END AS a FROM bsent, unnest(range(1, len(ws) + 1)) AS u(i)),
c1 AS (SELECT w, count(*) AS c FROM bi GROUP BY w), c2 AS (SELECT b, w, count(*) AS c FROM tri GROUP BY ALL),
t2 AS (SELECT b, sum(c) AS t FROM c2 GROUP BY b), f2 AS (SELECT a AS b, count(*) AS f FROM bi GROUP BY a), t3 AS (SELECT a, b, sum(c) AS t, count(*) AS f FROM tri GROUP BY ALL),
j AS (SELECT tok.id, tok.pos, tok.w, coalesce(c1.c, 0)::DOUBLE / (SELECT count(*) FROM bi) AS p1, t2.t AS t2, f2.f AS f2, coalesce(c2.c, 0) AS c2, t3.t AS t3, t3.f AS f3, coalesce(tri.c, 0) AS c3
  FROM tok LEFT JOIN c1 ON c1.w = tok.w LEFT JOIN t2 ON t2.b = tok.b LEFT JOIN f2 ON f2.b = tok.b LEFT JOIN c2 ON c2.b = tok.b AND c2.w = tok.w LEFT JOIN t3 ON t3.a = tok.a AND t3.b = tok.b LEFT JOIN tri ON tri.a = tok.a AND tri.b = tok.b AND tri.w = tok.w),
k AS (SELECT *, CASE WHEN t2 IS NOT NULL THEN greatest(c2 - {D}::DOUBLE, 0) / t2 + {D}::DOUBLE * coalesce(f2, 0) / t2 * p1 ELSE p1 END AS p2 FROM j),
s AS (SELECT id, pos, w, CASE WHEN t3 IS NOT NULL THEN greatest(c3 - {D}::DOUBLE, 0) / t3 + {D}::DOUBLE * f3 / t3 * p2 ELSE p2 END AS p FROM k) """


def g07(spark, d):
    return N.ngram_counts(_sentences(spark, d), 3).select("n", F.concat_ws(" ", "ctx").alias("ctx"), "word", "c")


def g08(spark, d):
    return N.continuation_counts(N.ngram_counts(_sentences(spark, d), 3)).select("n", F.concat_ws(" ", "ctx").alias("ctx"), "word", "c")


def g09(spark, d):
    return N.context_totals(N.ngram_counts(_sentences(spark, d), 2)).where("n = 2").select(F.element_at("ctx", 1).alias("ctx"), "total", "followers")


def _scored(spark, d) -> DataFrame:
    return N.scored(N.token_contexts(_benchmark(spark, d), 3, "id"), N.ngram_counts(_sentences(spark, d), 3), 3, D)


def l02(spark, d):
    return N.vocabulary(_sentences(spark, d))


def l03(spark, d):
    v = N.vocabulary(_sentences(spark, d)).select("word", F.col("word").alias("known"))
    t = _benchmark(spark, d).select("id", F.posexplode("words").alias("pos", "word"))
    return t.join(v, "word", "left").select("id", "pos", F.coalesce("known", F.lit("<UNK>")).alias("word"))


def l06(spark, d):
    return _scored(spark, d).select("id", "pos", F.round("p", 9).alias("p"))


def l08(spark, d):
    return N.perplexity(_scored(spark, d), "id").select("id", F.round("perplexity", 5).alias("perplexity"))


def l10(spark, d):
    """Character model over part names: counts of order 4."""
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.filter(F.split("p_name", ""), lambda x: x != "").alias("words"))
    return N.ngram_counts(p, 4).where("n = 4").select(F.concat_ws("", "ctx", "word").alias("gram"), "c")


def l12(spark, d):
    """Base-V numbers of the contexts of order 3."""
    v = _sentences(spark, d).select(F.explode("words").alias("word")).distinct().withColumn("id", F.xxhash64("word"))
    return v.select("word", N.flat_index(F.array(F.length("word"), F.ascii("word")), 1000).alias("flat"))


def _chat_role(spark, d):
    return load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lower("text").alias("t"))


KEYWORDS = [("place", ["ville", "ation", "ting"]), ("person", ["der", "ion", "man"]), ("thing", ["the", "que"])]


def g18(spark, d):
    """The type with most of its keywords in the text; ties to the first, none: event."""
    n = F.array(*(F.struct(sum((F.contains("t", F.lit(w)).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(t).alias("type")) for k, (t, ws) in enumerate(KEYWORDS)))
    best = F.array_max(n)
    return _chat_role(spark, d).select("id", F.when(best["n"] > 0, best["type"]).otherwise("event").alias("type"))


_KW = [" + ".join(f"contains(t, '{w}')::INT" for w in ws) for _, ws in KEYWORDS]


def p01(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 4 == 0, "").otherwise((F.col("p_size") % 4).cast("string")), F.lit("d6"), F.when(F.col("p_size") % 2 == 0, "+3").otherwise("")).alias("expr"))
    return p.select("p_partkey", "expr", P.dice(F.col("expr"), 42, F.col("p_partkey")).alias("roll"))


def p02(spark, d):
    items = load(spark, d, "nation").agg(F.sort_array(F.collect_list("n_name")).alias("items"))
    return load(spark, d, "orders").select("o_orderkey").join(F.broadcast(items)).select("o_orderkey", P.pick(F.col("items"), 42, F.col("o_orderkey")).alias("item"))


def p03(spark, d):
    return P.shuffled(load(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"], 42, "p_partkey").select("p_partkey", "place")


def _lookup(spark, d):
    return load(spark, d, "nation").select(F.col("n_regionkey").alias("table"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("item"), (F.col("n_nationkey") % 4 + 1).alias("weight"))


def _drawn(spark, d, items):
    t = P.cumulated(items, "table", "pos", "item", "weight")
    o = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("table"))
    return o.join(F.broadcast(t), "table").select("o_orderkey", P.weighted_draw(F.col("items"), uniform(42, "o_orderkey")).alias("item"))


def p04(spark, d):
    return _drawn(spark, d, _lookup(spark, d))


def p05(spark, d):
    i = _lookup(spark, d)
    a = _drawn(spark, d, P.biased(i, F.col("item").contains("A"), "weight", "table")).withColumn("kind", F.lit("filtered"))
    return a.unionByName(_drawn(spark, d, P.biased(i, F.col("item").contains("IN"), "weight", "table", boost=True)).withColumn("kind", F.lit("boosted")))


def p06(spark, d):
    """A template of three draws, the last one gated by a throw of one die."""
    t = P.cumulated(_lookup(spark, d), "table", "pos", "item", "weight").agg(F.map_from_entries(F.collect_list(F.struct("table", "items"))).alias("m"))
    o = load(spark, d, "orders").select("o_orderkey").join(F.broadcast(t))
    draw = lambda k: P.weighted_draw(F.col("m")[F.lit(k)], uniform(42, "o_orderkey", F.lit(k)))
    gate = P.dice(F.lit("1d6"), 7, F.col("o_orderkey")) >= 4
    return o.select("o_orderkey", F.concat(F.lit("A "), draw(0), F.lit(" from "), draw(1), F.when(gate, F.concat(F.lit(" with "), draw(2))).otherwise("")).alias("text"))


def _draw_sql(table: str, u: str, items: str = "cum") -> str:
    return f"(SELECT arg_min(item, upto) FROM {items} c WHERE c.t = {table} AND upto >= {u} * (SELECT max(upto) FROM {items} z WHERE z.t = {table}))"


_CUM = "items AS (SELECT n_regionkey AS t, n_nationkey AS pos, n_name AS item, n_nationkey % 4 + 1 AS weight FROM nation), cum AS (SELECT t, item, sum(weight) OVER (PARTITION BY t ORDER BY pos) AS upto FROM items)"
_BIAS = "fi AS (SELECT * FROM items i WHERE contains(item, 'A') OR NOT EXISTS (SELECT 1 FROM items j WHERE j.t = i.t AND contains(j.item, 'A'))), fcum AS (SELECT t, item, sum(weight) OVER (PARTITION BY t ORDER BY pos) AS upto FROM fi), bi AS (SELECT t, pos, item, CASE WHEN contains(item, 'IN') THEN weight + (SELECT sum(weight) FROM items j WHERE j.t = i.t) ELSE weight END AS weight FROM items i), bcum AS (SELECT t, item, sum(weight) OVER (PARTITION BY t ORDER BY pos) AS upto FROM bi)"
_U = uniform_sql(42, "o_orderkey")


def _grid(spark, d) -> DataFrame:
    line = load(spark, d, "lineitem")
    return line.groupBy((F.col("l_orderkey") % 24).cast("int").alias("y"), (F.col("l_partkey") % 24).cast("int").alias("x")).agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count("*") / 50).alias("v"))


def _seeds(spark, d) -> DataFrame:
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") * 7) % 24).cast("int").alias("sy"), ((F.col("n_nationkey") * 11) % 24).cast("int").alias("sx"))


_GRID = "grid AS (SELECT (l_orderkey % 24)::INT AS y, (l_partkey % 24)::INT AS x, sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*) / 50 AS v FROM lineitem GROUP BY ALL), seeds AS (SELECT n_nationkey AS k, ((n_nationkey * 7) % 24)::INT AS sy, ((n_nationkey * 11) % 24)::INT AS sx FROM nation)"
_NEAR = "near AS (SELECT y, x, v, arg_min(k, ((y - sy) * (y - sy) + (x - sx) * (x - sx)) * 100 + k) AS seed FROM grid, seeds GROUP BY ALL)"
_CLS = "cls AS (SELECT y, x, v, CASE WHEN v < 0.5 THEN 0 ELSE 1 END AS class, y * 4294967296 + x AS id FROM grid)"
_REACH = f"WITH RECURSIVE {_GRID}, {_CLS}, e AS (SELECT a.id AS s, b.id AS t FROM cls a JOIN cls b ON a.class = b.class AND abs(a.y - b.y) + abs(a.x - b.x) = 1), r AS (SELECT id AS s, id AS t FROM cls UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s), comp AS (SELECT s AS id, min(t) AS label FROM r GROUP BY s) "


def _classes(spark, d):
    return _grid(spark, d).withColumn("class", F.when(F.col("v") < 0.5, 0).otherwise(1))


def g14(spark, d):
    """The exponent that puts 40 % of the normalised values under 0.5, from the exact nearest-rank quantile."""
    g = H.normalised(_grid(spark, d).withColumn("map", F.lit(0)))
    return H.water_exponents(g, 0.4, 0.5).select(F.round("gamma", 6).alias("gamma"))


def g12(spark, d):
    return G.relaxed(_seeds(spark, d), _grid(spark, d), 3, 5).select("k", F.round("sy", 6).alias("sy"), F.round("sx", 6).alias("sx"))


def x04(spark, d):
    return _grid(spark, d).select("y", "x", F.round(G.edge_falloff(F.col("v"), F.col("y"), F.col("x"), 24, 24, 6.0, 0.05), 9).alias("v"))


def x07(spark, d):
    return G.components(_classes(spark, d)).select("y", "x", "label")


def x08(spark, d):
    c = G.components(_classes(spark, d))
    n = G.neighbours(c, G.FOUR, ["class", "label"])
    near = c.join(n, ["y", "x"]).where("n_class <> class").groupBy("label").agg(F.count_distinct("n_label").alias("others"))
    edge = c.groupBy("label").agg(F.count("*").alias("cells"), F.bool_or((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == 23) | (F.col("x") == 23)).alias("touches_edge"))
    return edge.join(near, "label", "left").select("label", "cells", "touches_edge", F.coalesce("others", F.lit(0)).alias("others"))


def x11(spark, d):
    return G.descent_paths(_grid(spark, d), 0.45, 48).select("y0", "x0", "length", "ends_in_water")


def x17(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    i = F.row_number().over(w) - 1
    return load(spark, d, "part").select("p_partkey", (i % 8).alias("col"), F.floor(i / 8).cast("int").alias("row"))


def x18(spark, d):
    """Layers of marks on a canvas: the latest order of a pixel wins."""
    o = load(spark, d, "orders")
    return o.groupBy((F.col("o_orderkey") % 16).alias("y"), (F.col("o_custkey") % 16).alias("x")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("mark"))


def _moved(k: int) -> str:
    """CTE: the seeds after round k, by the middles of the cells that are nearest to them."""
    return f"""n{k} AS (SELECT y, x, arg_min(k, ((y - sy) * (y - sy) + (x - sx) * (x - sx), k)) AS k FROM grid, s{k} GROUP BY ALL),
s{k + 1} AS (SELECT s{k}.k, CASE WHEN s{k}.k >= 5 THEN coalesce(my, sy) ELSE sy END AS sy, CASE WHEN s{k}.k >= 5 THEN coalesce(mx, sx) ELSE sx END AS sx FROM s{k} LEFT JOIN (SELECT k, avg(y) AS my, avg(x) AS mx FROM n{k} GROUP BY k) m ON m.k = s{k}.k)"""


_G12 = f"WITH {_GRID}, s0 AS (SELECT k, sy::DOUBLE AS sy, sx::DOUBLE AS sx FROM seeds), {_moved(0)}, {_moved(1)}, {_moved(2)} SELECT k, round(sy, 6) AS sy, round(sx, 6) AS sx FROM s3"
_X11 = f"""WITH RECURSIVE {_GRID}, turn(dy, dx, place) AS (VALUES (-1, 0, 0), (0, 1, 1), (1, 0, 2), (0, -1, 3)),
low AS (SELECT a.y, a.x, a.v, b.y AS ny, b.x AS nx, b.v AS nv FROM grid a, turn JOIN grid b ON b.y = a.y + dy AND b.x = a.x + dx QUALIFY row_number() OVER (PARTITION BY a.y, a.x ORDER BY b.v, place) = 1),
walk AS (SELECT y AS y0, x AS x0, y, x, [y * 24 + x] AS seen, false AS wet FROM grid WHERE v >= 0.45
  UNION ALL SELECT y0, x0, ny, nx, list_append(seen, ny * 24 + nx), nv < 0.45 FROM walk JOIN low USING (y, x) WHERE NOT wet AND nv <= v + 0.03 AND len(seen) <= 48 AND NOT list_contains(seen, ny * 24 + nx))
SELECT y0, x0, max(len(seen))::INT AS length, bool_or(wet) AS ends_in_water FROM walk GROUP BY ALL"""

_CASES = {
    "g07": (g07, _L + "SELECT 1 AS n, '' AS ctx, w AS word, c FROM uni UNION ALL SELECT 2, a, w, c FROM bi UNION ALL SELECT 3, a || ' ' || b, w, c FROM tri"),
    "g08": (g08, _L + "SELECT 1 AS n, '' AS ctx, w AS word, count(*) AS c FROM bi GROUP BY w UNION ALL SELECT 2, b, w, count(*) FROM tri GROUP BY b, w"),
    "g09": (g09, _L + "SELECT a AS ctx, sum(c)::BIGINT AS total, count(*) AS followers FROM bi GROUP BY a"),
    "l02": (l02, _L + "SELECT w AS word FROM uni UNION SELECT '<UNK>'"),
    "l03": (l03, _L + "SELECT id, (i - 1)::INT AS pos, coalesce(uni.w, '<UNK>') AS word FROM (SELECT id, i, ws[i] AS w FROM bsent, unnest(range(1, len(ws) + 1)) AS u(i)) t LEFT JOIN uni ON uni.w = t.w"),
    "l04": (lambda s, d: N.continuation_counts(N.ngram_counts(_sentences(s, d), 2)).where("n = 1").join(F.broadcast(N.ngram_counts(_sentences(s, d), 2).where("n = 2").agg(F.count("*").alias("t")))).select("word", F.round(F.col("c") / F.col("t"), 12).alias("p")), _L + "SELECT w AS word, round(count(*)::DOUBLE / (SELECT count(*) FROM bi), 12) AS p FROM bi GROUP BY w"),
    "l06": (l06, _SCORE + "SELECT id, pos::INT AS pos, round(p, 9) AS p FROM s"),
    "l08": (l08, _SCORE + "SELECT id, round(coalesce(pow(2.0::DOUBLE, -avg(log2(p)) FILTER (p > 0)), 'inf'::DOUBLE), 5) AS perplexity FROM s GROUP BY id"),
    "l09": (lambda s, d: g07(s, d).where("n = 3").groupBy("ctx").agg(F.sum("c").alias("total"), F.max("c").alias("most")), _L + "SELECT a || ' ' || b AS ctx, sum(c)::BIGINT AS total, max(c) AS most FROM tri GROUP BY ALL"),
    "l10": (l10, "SELECT p_name[i:i + 3] AS gram, count(*) AS c FROM part, unnest(range(1, length(p_name) - 2)) AS u(i) GROUP BY ALL"),
    "l12": (l12, _L + "SELECT w AS word, length(w) * 1000 + ascii(w) AS flat FROM uni"),
    "l15": (lambda s, d: N.context_totals(N.ngram_counts(_sentences(s, d), 3)).where("n = 3").select(F.concat_ws(" ", "ctx").alias("ctx"), "total", "followers"), _L + "SELECT a || ' ' || b AS ctx, sum(c)::BIGINT AS total, count(*) AS followers FROM tri GROUP BY ALL"),
    "g16": (lambda s, d: N.perplexity(_scored(s, d).withColumn("id", F.lit(0)), "id").select(F.round("perplexity", 4).alias("perplexity")), _SCORE + "SELECT round(pow(2.0::DOUBLE, -avg(log2(p)) FILTER (p > 0)), 4) AS perplexity FROM s"),
    "g18": (g18, f"SELECT id, CASE WHEN greatest(a, b, c) = 0 THEN 'event' WHEN a = greatest(a, b, c) THEN 'place' WHEN b = greatest(a, b, c) THEN 'person' ELSE 'thing' END AS type FROM (SELECT id, {_KW[0]} AS a, {_KW[1]} AS b, {_KW[2]} AS c FROM (SELECT conv_id * 1000 + turn AS id, lower(text) AS t FROM conversations))"),
    "p01": (p01, f"WITH p AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1 ELSE p_size % 4 END AS n, p_size FROM part) SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE (p_size % 4)::VARCHAR END || 'd6' || CASE WHEN p_size % 2 = 0 THEN '+3' ELSE '' END AS expr, (sum(floor({uniform_sql(42, 'p_partkey', 'i')} * 6) + 1) + CASE WHEN p_size % 2 = 0 THEN 3 ELSE 0 END)::INT AS roll FROM p, unnest(range(1, n + 1)) AS u(i) GROUP BY p_partkey, p_size"),
    "p02": (p02, f"WITH i AS (SELECT list(n_name ORDER BY n_name) AS l FROM nation) SELECT o_orderkey, l[floor({_U} * len(l))::INT + 1] AS item FROM orders, i"),
    "p03": (p03, f"SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {uniform_sql(42, 'p_partkey')}, p_partkey)::INT AS place FROM part"),
    "p04": (p04, f"WITH {_CUM}, o AS (SELECT o_orderkey, o_orderkey % 5 AS t, {_U} AS u FROM orders), m AS (SELECT t, max(upto) AS total FROM cum GROUP BY t) SELECT o_orderkey, arg_min(item, upto) AS item FROM o JOIN m USING (t) JOIN cum USING (t) WHERE upto >= u * total GROUP BY o_orderkey"),
    "p05": (p05, f"WITH {_CUM}, {_BIAS}, o AS (SELECT o_orderkey, o_orderkey % 5 AS t, {_U} AS u FROM orders) SELECT o_orderkey, arg_min(item, upto) AS item, 'filtered' AS kind FROM o JOIN (SELECT t, max(upto) AS total FROM fcum GROUP BY t) USING (t) JOIN fcum USING (t) WHERE upto >= u * total GROUP BY o_orderkey UNION ALL SELECT o_orderkey, arg_min(item, upto), 'boosted' FROM o JOIN (SELECT t, max(upto) AS total FROM bcum GROUP BY t) USING (t) JOIN bcum USING (t) WHERE upto >= u * total GROUP BY o_orderkey"),
    "p06": (p06, f"WITH {_CUM}, o AS (SELECT o_orderkey, unnest([0, 1, 2]) AS t FROM orders), dr AS (SELECT o_orderkey, t, arg_min(item, upto) AS item FROM (SELECT *, {uniform_sql(42, 'o_orderkey', 't')} AS u FROM o) JOIN (SELECT t, max(upto) AS total FROM cum GROUP BY t) USING (t) JOIN cum USING (t) WHERE upto >= u * total GROUP BY ALL) SELECT o_orderkey, 'A ' || max(item) FILTER (t = 0) || ' from ' || max(item) FILTER (t = 1) || CASE WHEN floor({uniform_sql(7, 'o_orderkey', '1')} * 6) + 1 >= 4 THEN ' with ' || max(item) FILTER (t = 2) ELSE '' END AS text FROM dr GROUP BY o_orderkey"),
    "g10": (lambda s, d: G.tiles(_grid(s, d), 4).select("ty", "tx", F.round("mean", 9).alias("mean"), F.round("centre", 9).alias("centre")), f"WITH {_GRID} SELECT (y // 4)::BIGINT AS ty, (x // 4)::BIGINT AS tx, round(avg(v), 9) AS mean, round(max(v) FILTER (y % 4 = 2 AND x % 4 = 2), 9) AS centre FROM grid GROUP BY ALL"),
    "g11": (lambda s, d: G.region_blend(G.nearest_seed(_grid(s, d), _seeds(s, d))).select("y", "x", "seed", F.round("v", 9).alias("v")), f"WITH {_GRID}, {_NEAR} SELECT y, x, seed, round(0.82::DOUBLE * avg(v) OVER (PARTITION BY seed) + 0.18::DOUBLE * v, 9) AS v FROM near"),
    "g12": (g12, _G12),
    "g13": (lambda s, d: G.normalised(_grid(s, d)).select("y", "x", F.round("v", 9).alias("v")), f"WITH {_GRID} SELECT y, x, round((v - (SELECT min(v) FROM grid)) / (SELECT max(v) - min(v) FROM grid), 9) AS v FROM grid"),
    "g14": (g14, f"WITH {_GRID}, n AS (SELECT (v - (SELECT min(v) FROM grid)) / (SELECT max(v) - min(v) FROM grid) AS v FROM grid), p AS (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM n WHERE v > 0) SELECT round(ln(0.5) / ln(v), 6) AS gamma FROM p WHERE r = ceil(n * 2 / 5)"),
    "x02": (lambda s, d: G.resized(_grid(s, d), 24, 24, 10, 10).select("ty", "tx", F.round("v", 9).alias("v")), f"WITH {_GRID}, t AS (SELECT ty::INT AS ty, tx::INT AS tx, ty / 10.0::DOUBLE * 23 AS fy, tx / 10.0::DOUBLE * 23 AS fx FROM range(10) a(ty), range(10) b(tx)) SELECT ty, tx, round(sum((CASE WHEN dy = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE WHEN dx = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) * v), 9) AS v FROM t, range(2) c(dy), range(2) e(dx), grid WHERE y = least(floor(fy) + dy, 23) AND x = least(floor(fx) + dx, 23) GROUP BY ALL"),
    "x04": (x04, f"WITH {_GRID} SELECT y, x, round(0.05::DOUBLE + (v - 0.05::DOUBLE) * t * t * (3 - 2 * t), 9) AS v FROM (SELECT *, greatest(least(least(y, x, 23 - y, 23 - x) / 6.0::DOUBLE, 1.0), 0.0) AS t FROM grid)"),
    "x07": (x07, _REACH + "SELECT y, x, label FROM cls JOIN comp USING (id)"),
    "x08": (x08, _REACH + ", c AS (SELECT * FROM cls JOIN comp USING (id)) SELECT label, count(*) AS cells, bool_or(y = 0 OR x = 0 OR y = 23 OR x = 23) AS touches_edge, (SELECT count(DISTINCT b.label) FROM c a JOIN c b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.class <> b.class WHERE a.label = c.label) AS others FROM c GROUP BY label"),
    "x10": (lambda s, d: G.neighbours(_grid(s, d), G.EIGHT, ["v"]).groupBy("y", "x").agg(F.count("*").alias("n"), F.round(F.min("n_v"), 9).alias("low")), f"WITH {_GRID} SELECT a.y, a.x, count(*) AS n, round(min(b.v), 9) AS low FROM grid a JOIN grid b ON greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1 GROUP BY ALL"),
    "x11": (x11, _X11),
    "x13": (lambda s, d: _classes(s, d).where("class = 1").join(G.neighbours(_classes(s, d), G.EIGHT, ["class"]).where("n_class = 0"), ["y", "x"], "left_semi").select("y", "x"), f"WITH {_GRID} SELECT y, x FROM grid a WHERE v >= 0.5 AND EXISTS (SELECT 1 FROM grid b WHERE b.v < 0.5 AND greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1)"),
    "x17": (x17, "SELECT p_partkey, (i % 8)::INT AS col, (i // 8)::INT AS row FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) - 1 AS i FROM part)"),
    "x18": (x18, "SELECT o_orderkey % 16 AS y, o_custkey % 16 AS x, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS mark FROM orders GROUP BY ALL"),
}

QUERIES = {k: f for k, (f, _) in _CASES.items()}
SQL = {k: sql for k, (_, sql) in _CASES.items() if sql}
