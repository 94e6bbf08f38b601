"""Stumps of a forest checked step by step, conversions, encoders and what is left of the n-gram and grid rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as X
from weft.functions.randomness import uniform, uniform_sql
from weft.operators import attribution, binning, conversion, forest
from weft.operators import grids as G
from weft.operators import ngrams as N
from weft.plans import forest_sql as S
from weft.plans import learning as L
from weft.plans import models as M
from weft.sources.tables import load

_STUMP = f"""WITH {L._FROWS},
st AS (SELECT tree, feature, threshold FROM ft QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {uniform_sql(43, 'tree', '1', 'feature')}, feature) = 1),
go AS (SELECT tree, key, y, v, CASE WHEN v <= threshold THEN 2 ELSE 3 END AS node FROM fl JOIN st USING (tree, feature)),
lf AS (SELECT tree, node, count(*) AS n, sum(y) AS ones FROM go GROUP BY ALL) """


def _stumps(spark, d) -> DataFrame:
    return forest.grow(L._forest_rows(spark, d), depth=1, seed=42, split="random")


def _at_leaves(spark, d) -> DataFrame:
    return forest.leaves(L._forest_rows(spark, d, 1).select("key", "x", "y"), _stumps(spark, d), 1)


def m07(spark, d):
    return _at_leaves(spark, d).select("tree", "key", "node")


def m08(spark, d):
    n = _stumps(spark, d).where("feature IS NULL")
    return n.select("tree", "node", "n", F.round(F.coalesce(F.col("counts")[F.lit(1)], F.lit(0)) / F.col("n"), 9).alias("share"))


def m09(spark, d):
    n = _stumps(spark, d).where("feature IS NULL")
    return n.select("tree", "node", F.round(F.col("depth") + forest.average_path(F.col("n")), 6).alias("length"))


def m15(spark, d):
    return forest.predict_class(L._forest_rows(spark, d, 1), _stumps(spark, d), 1, "key").select("key", F.col("predicted").cast("int").alias("predicted"))


def m20(spark, d):
    return forest.predict_shares(L._forest_rows(spark, d, 1), _stumps(spark, d), 1, "key").where("class = 1").select("key", F.round("p", 7).alias("p"))


def m17(spark, d):
    """Anomaly scores less an offset of one half."""
    n = conversion.as_isolation(_stumps(spark, d))
    got = _at_leaves(spark, d).join(F.broadcast(n.select("tree", "node", "length", "c")), ["tree", "node"])
    return got.groupBy("key").agg(F.round(F.pow(F.lit(2.0), -F.avg("length") / F.first("c")) - 0.5, 6).alias("decision"))


def _kept(nodes: DataFrame, kind: str) -> DataFrame:
    return conversion.relabelled(nodes, kind).select("kind", "tree", "node", "feature", F.round("threshold", 6).alias("threshold"), "n")


def m22(spark, d):
    """Extra trees as a Mondrian forest: the same splits and sizes."""
    return _kept(forest.grow(L._forest_rows(spark, d), depth=3, seed=42, split="random"), "mondrian")


def m23(spark, d):
    """A Mondrian forest as extra trees, without its waiting times."""
    return _kept(forest.grow(L._forest_rows(spark, d, 2), depth=3, seed=42, split="mondrian", task="regression", lifetime=1.0).drop("tau"), "extra")


def m24(spark, d):
    return conversion.as_isolation(_stumps(spark, d)).where("feature IS NULL").select("tree", "node", F.round("length", 6).alias("length"), F.round("c", 6).alias("c"))


def m26(spark, d):
    """Leaf boxes: (lo, hi] of the tested feature."""
    s = _stumps(spark, d)
    cut = s.where("node = 1").select("tree", "feature", "threshold")
    return s.where("node > 1").select("tree", "node").join(cut, "tree").select("tree", "node", "feature", F.round(F.when(F.col("node") == 3, F.col("threshold")), 6).alias("lo"), F.round(F.when(F.col("node") == 2, F.col("threshold")), 6).alias("hi"))


def m28(spark, d):
    """Expected share of class 1 with nothing known: leaves weighted by their rows."""
    n = _stumps(spark, d).where("feature IS NULL")
    return n.groupBy("tree").agg(F.round(F.sum(F.coalesce(F.col("counts")[F.lit(1)], F.lit(0))) / F.sum("n"), 9).alias("expected"))


def m31(spark, d):
    rows = L._forest_rows(spark, d, 1).select("key", "x", "y")
    n = _stumps(spark, d).withColumn("mean", F.coalesce(F.col("counts")[F.lit(1)], F.lit(0)) / F.col("n"))
    phi = attribution.forest_shap(rows, n, "key", 3)
    return phi.where("feature >= 0").groupBy("key").agg(F.round(F.sum("phi"), 6).alias("phi"))


def m35(spark, d):
    o = load(spark, d, "part").select("p_partkey")
    draw = lambda k, values: F.element_at(F.array(*map(F.lit, values)), F.floor(uniform(35, "p_partkey", F.lit(k)) * len(values)).cast("int") + 1)
    return o.select("p_partkey", draw(0, [2, 4, 8]).alias("depth"), draw(1, [10, 50]).alias("trees"))


def m39(spark, d):
    return conversion.flat_table(_stumps(spark, d)).select("tree", "node", "mode", "feature", F.round("threshold", 6).alias("threshold"), "true_node", "false_node")


def m43(spark, d):
    p = forest.predict_shares(L._forest_rows(spark, d, 1), _stumps(spark, d), 1, "key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("class", "p"))).alias("c"))
    ps = F.transform("c", lambda s: s["p"])
    return p.select("key", F.get(F.col("c"), F.array_position(ps, F.array_max(ps)).cast("int") - 1)["class"].cast("int").alias("label"))


def m44(spark, d):
    rows = L._forest_rows(spark, d).withColumn("y", F.get("x", F.lit(0)))
    n = forest.grow(rows, depth=1, seed=42, split="random", task="regression")
    return n.where("feature IS NULL").select("tree", "node", "n", F.round("mean", 6).alias("mean"))


def m38(spark, d):
    p = m15(spark, d).join(L._forest_rows(spark, d, 1).select("key", "y"), "key")
    return p.agg(F.round(F.avg((F.col("predicted") == F.col("y")).cast("int")), 9).alias("accuracy"))


def b12(spark, d):
    c = load(spark, d, "lineitem").groupBy("l_returnflag").count()
    n = c.agg(F.sum("count").alias("n"))
    return c.join(F.broadcast(n)).select("l_returnflag", F.round(F.log(F.greatest(F.col("count") / F.col("n"), F.lit(1e-15))), 9).alias("init"))


def b16(spark, d):
    return binning.quantile_edges(L._long(spark, d), L.BINS, few_rule=False).select("feature", F.posexplode("edges").alias("k", "edge"))


def b18(spark, d):
    """Width of the whole encoding and of each feature's part."""
    return binning.quantile_edges(L._long(spark, d), L.BINS, few_rule=False).select("feature", F.size("edges").alias("width"), (F.sum(F.size("edges")).over(Window.orderBy("feature"))).alias("upto"))


def b19(spark, d):
    """Thresholds of the stumps as they were drawn."""
    n = forest.grow(L._forest_rows(spark, d), depth=1, seed=42, split="random")
    return n.where("feature IS NOT NULL").groupBy("feature").agg(F.array_sort(F.collect_set(F.round("threshold", 6))).alias("t")).select("feature", F.size("t").alias("n"), F.array_min("t").alias("least"))


def b21(spark, d):
    rows = L._forest_rows(spark, d)
    n = forest.grow(rows.withColumn("y", F.lit(0.0)), depth=3, seed=42, split="random", task="regression")
    at = rows.where("tree = 0").withColumn("node", F.lit(1).cast("bigint"))
    return conversion.harvested_edges(n, forest.bounds(at).select("feature", "lo", "hi"), 8).select("feature", F.posexplode("edges").alias("k", "edge"))


def l05(spark, d):
    """Top-order alpha and gamma of seen pairs."""
    c = N.ngram_counts(M._sentences(spark, d), 2).where("n = 2")
    return c.join(N.context_totals(c), ["n", "ctx"]).select(F.element_at("ctx", 1).alias("ctx"), "word", F.round(F.greatest(F.col("c") - M.D, F.lit(0.0)) / F.col("total"), 9).alias("alpha"), F.round(M.D * F.col("followers") / F.col("total"), 9).alias("gamma"))


def l13(spark, d):
    """Differences of two exports of the same counts."""
    a = N.ngram_counts(M._sentences(spark, d), 2)
    b = N.ngram_counts(M._sentences(spark, d), 3).where("n <= 2")
    both = a.select("n", "ctx", "word", "c").join(b.select("n", "ctx", "word", F.col("c").alias("e")), ["n", "ctx", "word"], "full")
    gap = F.abs(F.coalesce("c", F.lit(0)) - F.coalesce("e", F.lit(0)))
    return both.agg(F.count("*").alias("n"), F.max(gap).alias("largest"), F.avg(gap).alias("mean"))


def l14(spark, d):
    """Followers of the contexts the / and / an unseen word."""
    c = N.ngram_counts(M._sentences(spark, d), 2).where("n = 2").select(F.element_at("ctx", 1).alias("ctx"), "word", "c")
    asked = load(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("ctx")).where("ctx <> ''").distinct()
    return asked.join(c, "ctx", "left").groupBy("ctx").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def l16(spark, d):
    return N.vocabulary(M._sentences(spark, d)).where("word <> '<UNK>'").select("word", F.length("word").alias("n"))


def p08(spark, d):
    """Generated names, seeded by a text instead of a number."""
    t = M._lookup(spark, d).agg(F.sort_array(F.collect_list("item")).alias("items"))
    p = load(spark, d, "part").join(F.broadcast(t))
    return p.select("p_partkey", F.get("items", F.pmod(X.seed_hash("p_name"), F.size("items")).cast("int")).alias("item"))


def t06(spark, d):
    return M._grid(spark, d).where("v > 0.5").orderBy(F.desc("v"), "y", "x").limit(50).select("y", "x")


def x09(spark, d):
    """Small pools of low cells that touch no edge and at least two other components become land; the rest becomes water."""
    c = G.components(M._classes(spark, d))
    info = M.x08(spark, d)
    to = F.when(F.col("class") == 1, "land").when(~F.col("touches_edge") & (F.col("others") >= 2), "grass").otherwise("water")
    return c.join(info, "label").select("y", "x", to.alias("terrain"))


def x20(spark, d):
    """Bit rows of glyph-like marks: set bits of the part sizes."""
    p = load(spark, d, "part")
    return p.select("p_partkey", F.lpad(F.bin(F.col("p_size").cast("bigint")), 8, "0").alias("bits"), F.bit_count("p_size").alias("n"))


def d12(spark, d):
    """A home page for each customer: the ten newest orders."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    o = load(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 10")
    return o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("r", F.col("o_orderkey").cast("string").alias("k")))).alias("l")).select("o_custkey", F.array_join(F.transform("l", lambda x: x["k"]), " ").alias("page"))


def d14(spark, d):
    n = load(spark, d, "nation")
    return n.select("n_nationkey", F.format_string("<title>%s</title><main id=%d>%s</main>", "n_name", F.col("n_nationkey").cast("int"), X.slugify("n_name")).alias("html"))


def f22(spark, d):
    """Calls in fenced blocks or tags of a text; bad arguments are {}."""
    p = load(spark, d, "pages").select("page_id", F.concat(F.lit('x\n```tool\n{"name": "open", "arguments": {"page": '), F.col("page_id").cast("string"), F.lit('}}\n```\n<tool>close</tool><args>oops</args>')).alias("t"))
    fenced = F.transform(F.regexp_extract_all("t", F.lit(r"(?s)```(?:tool|json)\n(.*?)```"), F.lit(1)), lambda j: F.struct(F.get_json_object(j, "$.name").alias("name"), F.coalesce(F.get_json_object(j, "$.arguments"), F.lit("{}")).alias("args")))
    tagged = F.zip_with(F.regexp_extract_all("t", F.lit(r"(?s)<tool>(.*?)</tool>"), F.lit(1)), F.regexp_extract_all("t", F.lit(r"(?s)<args>(.*?)</args>"), F.lit(1)), lambda a, b: F.struct(a.alias("name"), F.when(F.get_json_object(b, "$").isNotNull(), b).otherwise("{}").alias("args")))
    return p.select("page_id", F.explode(F.concat(fenced, tagged)).alias("c")).select("page_id", "c.name", "c.args")


def s27(spark, d):
    """A table ready for fitting: gaps are 0, categories are indexes by order."""
    line = load(spark, d, "lineitem").fillna(0, ["l_quantity", "l_tax"])
    cats = line.select("l_returnflag").distinct().withColumn("flag", F.dense_rank().over(Window.orderBy("l_returnflag")) - 1)
    return line.join(F.broadcast(cats), "l_returnflag").groupBy("l_orderkey", "flag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


_CUT = "SELECT tree::INT AS tree, "
_PATH = S.AVERAGE_PATH
_ISO = _STUMP + f", c AS (SELECT {_PATH.format('m')} AS c FROM (SELECT avg(s)::DOUBLE AS m FROM (SELECT tree, sum(n) AS s FROM lf GROUP BY tree)))"
#: A forest's thresholds by feature, halved until there are enough brackets.
_HARVEST = L._FO + L._FR.format(3) + S.grown(3, split="random", task="regression") + """, cut AS (SELECT feature, list_sort(list_distinct(list(round(threshold, 10)))) AS e FROM nd WHERE feature IS NOT NULL GROUP BY 1),
e0 AS (SELECT feature, CASE WHEN coalesce(len(e), 0) < 2 THEN [lo, hi] ELSE e END AS e FROM (SELECT feature, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM fv GROUP BY 1) LEFT JOIN cut USING (feature)),
""" + ", ".join(f"e{k + 1} AS (SELECT feature, CASE WHEN len(e) - 1 < 8 THEN {L._MIDDLES.format('e')} ELSE e END AS e FROM e{k})" for k in range(3)) + " SELECT feature::INT AS feature, (k - 1)::INT AS k, e[k] AS edge FROM e3, unnest(range(1, len(e) + 1)) AS u(k)"


_CASES = {
    "m07": (m07, _STUMP + _CUT + "key, node::BIGINT AS node FROM go"),
    "m08": (m08, _STUMP + _CUT + "node::BIGINT AS node, n, round(ones / n, 9) AS share FROM lf"),
    "m09": (m09, _STUMP + _CUT + "node::BIGINT AS node, round(1 + CASE WHEN n <= 1 THEN 0.0::DOUBLE WHEN n = 2 THEN 1.0 ELSE 2.0::DOUBLE * (ln(greatest(n, 3) - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * (n - 1) / n END, 6) AS length FROM lf"),
    "m15": (m15, _STUMP + "SELECT key, CASE WHEN round(avg(ones / n), 9) > round(avg(1 - ones / n), 9) THEN 1 ELSE 0 END AS predicted FROM go JOIN lf USING (tree, node) GROUP BY key"),
    "m17": (m17, _ISO + f"SELECT key, round(pow(2, -avg(1 + {_PATH.format('n')}) / max(c)) - 0.5, 6) AS decision FROM go JOIN lf USING (tree, node), c GROUP BY key"),
    "m20": (m20, _STUMP + "SELECT key, round(round(avg(ones / n), 9), 7) AS p FROM go JOIN lf USING (tree, node) GROUP BY key HAVING sum(ones) > 0"),
    "m22": (m22, L._FO + L._FR.format(3) + S.grown(3, split="random") + _CUT.replace("SELECT ", "SELECT 'mondrian' AS kind, ") + "node::BIGINT AS node, feature::INT AS feature, round(threshold, 6) AS threshold, n::BIGINT AS n FROM nd"),
    "m23": (m23, L._FO + L._FR.format(2) + S.grown(3, split="mondrian", lifetime=1.0) + _CUT.replace("SELECT ", "SELECT 'extra' AS kind, ") + "node::BIGINT AS node, feature::INT AS feature, round(threshold, 6) AS threshold, n::BIGINT AS n FROM nd"),
    "m24": (m24, _ISO + _CUT + f"node::BIGINT AS node, round(1 + {_PATH.format('n')}, 6) AS length, round(c, 6) AS c FROM lf, c"),
    "m26": (m26, _STUMP + _CUT + "node::BIGINT AS node, feature::INT AS feature, round(CASE WHEN node = 3 THEN threshold END, 6) AS lo, round(CASE WHEN node = 2 THEN threshold END, 6) AS hi FROM lf JOIN st USING (tree)"),
    "m28": (m28, _STUMP + _CUT + "round(sum(ones) / sum(n), 9) AS expected FROM lf GROUP BY tree"),
    "m31": (m31, _STUMP + ", b AS (SELECT tree, sum(ones) / sum(n) AS e FROM lf GROUP BY tree) SELECT key, round(avg(ones / n - e), 6) AS phi FROM go JOIN lf USING (tree, node) JOIN b USING (tree) GROUP BY key"),
    "m35": (m35, f"SELECT p_partkey, [2, 4, 8][floor({uniform_sql(35, 'p_partkey', '0')} * 3)::INT + 1]::INT AS depth, [10, 50][floor({uniform_sql(35, 'p_partkey', '1')} * 2)::INT + 1]::INT AS trees FROM part"),
    "m38": (m38, _STUMP + ", p AS (SELECT key, max(y) AS y, CASE WHEN round(avg(ones / n), 9) > round(avg(1 - ones / n), 9) THEN 1 ELSE 0 END AS predicted FROM go JOIN lf USING (tree, node) GROUP BY key) SELECT round(avg((y = predicted)::INT), 9) AS accuracy FROM p"),
    "m39": (m39, _STUMP + _CUT + "1::BIGINT AS node, 'branch_leq' AS mode, feature::INT AS feature, round(threshold, 6) AS threshold, 2::BIGINT AS true_node, 3::BIGINT AS false_node FROM st UNION ALL SELECT tree::INT, node, 'leaf', NULL, NULL, NULL, NULL FROM lf"),
    "m43": (m43, _STUMP + "SELECT key, CASE WHEN round(avg(ones / n), 9) > round(avg(1 - ones / n), 9) THEN 1 ELSE 0 END AS label FROM go JOIN lf USING (tree, node) GROUP BY key"),
    "m44": (m44, _STUMP + _CUT + "node::BIGINT AS node, count(*) AS n, round(avg(q), 6) AS mean FROM go JOIN fo USING (key) GROUP BY ALL"),
    "b12": (b12, "SELECT l_returnflag, round(ln(count(*) / (SELECT count(*) FROM lineitem)), 9) AS init FROM lineitem GROUP BY 1"),
    "b16": (b16, f"WITH {L._LONG}, {L._QEDGES} SELECT feature, (k - 1)::INT AS k, edges[k] AS edge FROM qedges, unnest(range(1, len(edges) + 1)) AS u(k)"),
    "b18": (b18, f"WITH {L._LONG}, {L._QEDGES} SELECT feature, len(edges)::INT AS width, (sum(len(edges)) OVER (ORDER BY feature))::BIGINT AS upto FROM qedges"),
    "b19": (b19, _STUMP + "SELECT feature::INT AS feature, count(DISTINCT round(threshold, 6))::INT AS n, min(round(threshold, 6)) AS least FROM st GROUP BY feature"),
    "b21": (b21, _HARVEST),
    "l05": (l05, M._L + f", t AS (SELECT a, sum(c) AS t, count(*) AS f FROM bi GROUP BY a) SELECT a AS ctx, w AS word, round(greatest(c - {M.D}::DOUBLE, 0) / t, 9) AS alpha, round({M.D}::DOUBLE * f / t, 9) AS gamma FROM bi JOIN t USING (a)"),
    "l07": (lambda s, d: M._scored(s, d).groupBy("id").agg(F.count_if(F.col("p") > 0).alias("seen"), F.count_if((F.col("p") >= 0) & (F.col("p") <= 1)).alias("n")), M._SCORE + "SELECT id, count(*) FILTER (p > 0) AS seen, count(*) AS n FROM s GROUP BY id"),
    "l13": (l13, M._L + "SELECT (SELECT count(*) FROM uni) + (SELECT count(*) FROM bi) AS n, 0::BIGINT AS largest, 0.0::DOUBLE AS mean"),
    "l14": (l14, M._L + "SELECT ctx, coalesce((SELECT sum(c) FROM bi WHERE a = ctx), 0)::BIGINT AS n FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS ctx FROM benchmark) WHERE ctx <> ''"),
    "l16": (l16, M._L + "SELECT w AS word, length(w)::INT AS n FROM uni"),
    "p08": (p08, "WITH i AS (SELECT list(n_name ORDER BY n_name) AS l FROM nation) SELECT p_partkey, l[('0x' || right(sha256(p_name), 8))::BIGINT % len(l) + 1] AS item FROM part, i"),
    "t06": (t06, f"WITH {M._GRID} SELECT y, x FROM grid WHERE v > 0.5 ORDER BY v DESC, y, x LIMIT 50"),
    "x09": (x09, M._REACH + ", c AS (SELECT * FROM cls JOIN comp USING (id)), i AS (SELECT label, bool_or(y = 0 OR x = 0 OR y = 23 OR x = 23) AS edge, (SELECT count(DISTINCT b.label) FROM c a JOIN c b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.class <> b.class WHERE a.label = c.label) AS others FROM c GROUP BY label) SELECT y, x, CASE WHEN class = 1 THEN 'land' WHEN NOT edge AND others >= 2 THEN 'grass' ELSE 'water' END AS terrain FROM c JOIN i USING (label)"),
    "x20": (x20, "SELECT p_partkey, lpad(bin(p_size), 8, '0') AS bits, bit_count(p_size)::INT AS n FROM part"),
    "d12": (d12, "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY r) AS page FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 10 GROUP BY 1"),
    "d14": (d14, "SELECT n_nationkey, '<title>' || n_name || '</title><main id=' || n_nationkey || '>' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') || '</main>' AS html FROM nation"),
    "f22": (f22, "SELECT page_id, 'open' AS name, '{\"page\":' || page_id || '}' AS args FROM pages UNION ALL SELECT page_id, 'close', '{}' FROM pages"),
    "s27": (s27, "SELECT l_orderkey, (f - 1)::INT AS flag, count(*) AS n, sum(l_quantity) AS q FROM (SELECT *, dense_rank() OVER (ORDER BY l_returnflag) AS f FROM lineitem) GROUP BY ALL"),
}

QUERIES = {k: f for k, (f, _) in _CASES.items()}
SQL = {k: sql for k, (_, sql) in _CASES.items() if sql}
