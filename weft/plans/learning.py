"""Binning, boosting, forests and metrics over lineitem, orders, events and labels (B, G, M rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.randomness import uniform, uniform_sql
from weft.operators import binning as B
from weft.operators import boosting, forest, sampling
from weft.plans import forest_sql as S
from weft.operators.storage import materialise
from weft.sources.tables import load

BINS = 16
FEATURES = ["l_quantity", "l_extendedprice", "l_tax"]
_LONG = "long AS (SELECT l_returnflag AS y, l_discount AS g, unnest([0, 1, 2]) AS feature, unnest([l_quantity, l_extendedprice, l_tax]) AS v FROM lineitem)"
_EDGES = "edges AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY feature)"
_BIN = f"CASE WHEN hi <= lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / {BINS})), {BINS - 1}) END::INT"
_BINNED = f"binned AS (SELECT y, g, feature, {_BIN} AS bin FROM long JOIN edges USING (feature))"
_HIST = "hist AS (SELECT feature, bin, sum((g - 0.05)::DECIMAL(18,4)) AS g, count(*) AS n FROM binned GROUP BY ALL)"
_WITH = f"WITH {_LONG}, {_EDGES}, {_BINNED}, {_HIST} "
_QEDGES = f"""ranked AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY feature) AS n FROM long),
wanted AS (SELECT DISTINCT feature, v FROM ranked JOIN range({BINS}) t(i) ON r = round_even(i * (n - 1) / {BINS}.0, 0)),
qedges AS (SELECT feature, list_append(list(v ORDER BY v), (SELECT max(v) FROM long l WHERE l.feature = w.feature)) AS edges FROM wanted w GROUP BY feature)"""


def _long(spark, d) -> DataFrame:
    line = load(spark, d, "lineitem").withColumns({"y": F.col("l_returnflag"), "g": F.col("l_discount")})
    return B.long_form(line, ["y", "g"], FEATURES)


def _binned(spark, d) -> DataFrame:
    long = _long(spark, d)
    return long.join(F.broadcast(B.uniform_edges(long, BINS)), "feature").withColumn("bin", B.uniform_bin(F.col("v"), F.col("lo"), F.col("hi"), BINS))


def b01(spark, d):
    return _binned(spark, d).groupBy("feature", "bin").count()


def b02(spark, d):
    return B.quantile_edges(_long(spark, d), BINS).select("feature", F.posexplode("edges").alias("k", "edge"))


def b03(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("feature"), F.col("o_totalprice").alias("v"))
    few = o.join(o.groupBy("feature").count().where("count <= 8"), "feature", "left_semi")
    return B.quantile_edges(few, 8).select("feature", F.posexplode("edges").alias("k", "edge"))


def _quantile_bins(spark, d):
    long = _long(spark, d)
    return long.join(F.broadcast(B.quantile_edges(long, BINS)), "feature").withColumn("bin", B.edge_bin(F.col("v"), F.col("edges")))


def b05(spark, d):
    long = _long(spark, d)
    e = B.uniform_edges(long, BINS).withColumn("edges", F.transform(F.sequence(F.lit(0), F.lit(BINS)), lambda i: F.col("lo") + i * ((F.col("hi") - F.col("lo")) / BINS)))
    return long.join(F.broadcast(e.select("feature", "edges")), "feature").withColumn("bin", B.edge_bin(F.col("v"), F.col("edges"))).groupBy("feature", "bin").count()


def _hist(spark, d):
    g = (F.col("g") - 0.05).cast("decimal(18,4)")
    return B.histogram(_binned(spark, d).withColumns({"g": g, "h": F.lit(1)}), [])


def b06(spark, d):
    return _hist(spark, d).select("feature", "bin", F.col("g").cast("double").alias("g"), F.col("h").cast("bigint").alias("h"), "n")


def b07(spark, d):
    """Best equal-width split of lineitem's discount over its features."""
    return B.best_split(_hist(spark, d), []).select("feature", "bin", F.round("gain", 3).alias("gain"), "n_left", "n_right")


def b10(spark, d):
    """Softmax gradients of a prior over return flags for each row's own flag."""
    line = load(spark, d, "lineitem")
    flags = line.groupBy("l_returnflag").count()
    n = flags.agg(F.sum("count").alias("n"))
    p = flags.join(F.broadcast(n)).select("l_returnflag", (F.col("count") / F.col("n")).alias("p"))
    return p.select(F.col("l_returnflag").alias("class"), F.round(F.col("p") - 1, 9).alias("g_own"), F.round("p", 9).alias("g_other"), F.round(F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-15)), 9).alias("h"), F.round(F.log("p"), 9).alias("init"))


def b11(spark, d):
    o = load(spark, d, "orders")
    mean = o.agg(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("m"))
    return o.join(F.broadcast(mean)).select("o_orderkey", F.round(F.col("m") - F.col("o_totalprice"), 4).alias("g"), F.lit(1).alias("h"))


def b13(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", uniform(13, "o_orderkey").alias("u"), F.pmod("o_orderkey", F.lit(8)).alias("part"))
    return sampling.ranked(o, ["part"], "u", "o_orderkey", "r").join(F.broadcast(o.groupBy("part").agg(F.greatest(F.lit(1), F.floor(F.count("*") * 0.5)).alias("m"))), "part").where("r <= m").select("o_orderkey")


def _boost_rows(spark, d):
    o = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("q"), F.count("*").cast("double").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("y"))
    return boosting.binned_features(o, "l_orderkey", ["q", "n"], 32).select("l_orderkey", "bins", (F.col("y") / 1000).alias("y"))


def _graded(spark, d):
    """Gradients of squared loss before the first tree."""
    rows = materialise(_boost_rows(spark, d))
    base = rows.agg(boosting.mean_of("y").alias("m"))
    return rows.join(F.broadcast(base)).select("l_orderkey", "bins", boosting.six_places(F.col("m") - F.col("y")).alias("g"), F.lit(1.0).alias("h"))


def b09(spark, d):
    return boosting.grow(_graded(spark, d), 3, 20).select("node", "feature", "bin", "gain", "n", "value")


def m46(spark, d):
    rows = _graded(spark, d)
    nodes = boosting.grow(rows, 3, 20).withColumn("class", F.lit(0))
    return boosting.tree_values(rows, nodes, 1, 3).select("l_orderkey", F.get("values", F.lit(0)).alias("value"))


def b14(spark, d):
    _, model = boosting.fit_regression(_boost_rows(spark, d), trees=2, depth=2, min_leaf=20, rate=0.3)
    return model.select("tree", "node", "feature", "bin", "n", "value")


def b15(spark, d):
    rows = materialise(_boost_rows(spark, d))
    base, model = boosting.fit_regression(rows, trees=2, depth=2, min_leaf=20, rate=0.3)
    out = boosting.predict_regression(rows, base, model, 2, 2, 0.3)
    return out.select("l_orderkey", "pred")


def _class_rows(spark, d):
    """Orders by status (F, O, P), told by size, number of lines and latest delivery."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.instr(F.lit("FOP"), F.col("o_orderstatus")) - 1).alias("y"))
    line = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("q"), F.count("*").cast("double").alias("n"), F.unix_date(F.max("l_shipdate").cast("date")).cast("double").alias("t"))
    return boosting.binned_features(line.join(o, "l_orderkey").where("y >= 0"), "l_orderkey", ["q", "n", "t"], 16).select("l_orderkey", "bins", "y")


def _thousandth(v):
    return F.floor(v * 1000 + 0.5) / 1000


def b14_classes(spark, d):
    _, model = boosting.fit_classes(_class_rows(spark, d), classes=3, rounds=2, depth=2, min_leaf=20, rate=0.3)
    return model.select("round", "class", "node", "feature", "bin", "n", _thousandth(F.col("value")).alias("value"))


def b15_classes(spark, d):
    rows = materialise(_class_rows(spark, d))
    base, model = boosting.fit_classes(rows, classes=3, rounds=2, depth=2, min_leaf=20, rate=0.3)
    out = boosting.predict_classes(rows, base, model, 2, 2, 0.3)
    return out.select("l_orderkey", "predicted", *(_thousandth(F.get("proba", F.lit(k))).alias(f"p{k}") for k in range(3)))


_BROWS = """WITH o AS (SELECT l_orderkey AS key, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS q, count(*)::DOUBLE AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS y FROM lineitem GROUP BY 1),
fs AS (SELECT key, unnest([0, 1]) AS feature, unnest([q, n]) AS v FROM o), nb AS (SELECT 32 AS bins),
t AS (SELECT key, 0 AS class, y / 1000 AS y FROM o),
p0 AS (SELECT key, class, (SELECT floor((sum(y::DECIMAL(28,6))::DOUBLE / count(*)) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE FROM t) AS pred FROM t),
"""
_CROWS = """WITH o AS (SELECT l_orderkey AS key, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS q, count(*)::DOUBLE AS n, date_diff('day', DATE '1970-01-01', max(l_shipdate)::DATE)::DOUBLE AS late, any_value(instr('FOP', o_orderstatus) - 1) AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING any_value(instr('FOP', o_orderstatus)) > 0),
fs AS (SELECT key, unnest([0, 1, 2]) AS feature, unnest([q, n, late]) AS v FROM o), nb AS (SELECT 16 AS bins),
t AS (SELECT key, class, y FROM o, range(3) c(class)),
p0 AS (SELECT key, class, (SELECT round(ln(greatest(count(*) FILTER (o.y = t.class) / count(*), 1e-15)), 6) FROM o) AS pred FROM t),
"""
_BINS_CTE = """fe AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM fs GROUP BY 1),
bn AS (SELECT key, feature, CASE WHEN hi <= lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / bins)), bins - 1) END::INT AS bin FROM fs JOIN fe USING (feature), nb)"""


def _tree_sql(t: int, depth: int, softmax: bool, rate: float) -> str:
    """CTEs of one round: gradients g{t}, levels unrolled, nodes n{t}, leaf values v{t} and the next scores p{t+1}."""
    if softmax:
        out = f""", s{t} AS (SELECT key, class, exp(pred - max(pred) OVER (PARTITION BY key)) AS e FROM p{t}),
q{t} AS (SELECT key, class, e / sum(e) OVER (PARTITION BY key) AS p FROM s{t}),
g{t} AS (SELECT key, class, (floor((p - (y = class)::INT) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE)::DECIMAL(28,6) AS g, (floor((greatest(p * (1 - p), 1e-15)) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE)::DECIMAL(28,6) AS h FROM q{t} JOIN t USING (key, class))"""
    else:
        out = f", g{t} AS (SELECT key, class, (floor((pred - y) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE)::DECIMAL(28,6) AS g, 1::DECIMAL(28,6) AS h FROM p{t} JOIN t USING (key, class))"
    out += f", a{t}_0 AS (SELECT key, class, 1 AS node FROM p{t})"
    for k in range(depth):
        out += f""", h{t}_{k} AS (SELECT class, node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM a{t}_{k} JOIN g{t} USING (key, class) JOIN bn USING (key) GROUP BY ALL),
w{t}_{k} AS (SELECT class, node, feature, bin, sum(g) OVER up::DOUBLE AS gl, sum(h) OVER up::DOUBLE AS hl, sum(n) OVER up AS nl, sum(g) OVER whole::DOUBLE AS gt, sum(h) OVER whole::DOUBLE AS ht, sum(n) OVER whole AS nt FROM h{t}_{k}
  WINDOW up AS (PARTITION BY class, node, feature ORDER BY bin), whole AS (PARTITION BY class, node, feature)),
k{t}_{k} AS (SELECT *, round(0.5::DOUBLE * (gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht), 3) AS gain FROM w{t}_{k} WHERE nl >= 20 AND nt - nl >= 20 AND hl >= 1e-15 AND ht - hl >= 1e-15),
b{t}_{k} AS (SELECT class, node, feature, bin, gain FROM (SELECT * FROM k{t}_{k} QUALIFY row_number() OVER (PARTITION BY class, node ORDER BY gain DESC, feature, bin) = 1) WHERE gain > 0),
a{t}_{k + 1} AS (SELECT key, class, node * 2 + (bn.bin > b.bin)::INT AS node FROM a{t}_{k} JOIN b{t}_{k} b USING (class, node) JOIN bn USING (key, feature))"""
    level = lambda k: f"SELECT {k} AS depth, key, class, node FROM a{t}_{k}"
    split = " UNION ALL ".join(f"SELECT class, node, feature, bin, gain FROM b{t}_{k}" for k in range(depth))
    out += f""", r{t} AS ({" UNION ALL ".join(level(k) for k in range(depth + 1))}), x{t} AS ({split}),
n{t} AS (SELECT class, node, feature, bin, gain, count(*) AS n, floor((-sum(g)::DOUBLE / greatest(sum(h)::DOUBLE, 1e-15)) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS value FROM r{t} JOIN g{t} USING (key, class) LEFT JOIN x{t} USING (class, node) GROUP BY ALL),
v{t} AS (SELECT key, class, arg_max(value, depth) AS value FROM r{t} JOIN n{t} USING (class, node) GROUP BY ALL),
p{t + 1} AS (SELECT key, class, floor((pred + {rate}::DOUBLE * value) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS pred FROM p{t} JOIN v{t} USING (key, class))"""
    return out


_B09 = _BROWS + _BINS_CTE + _tree_sql(0, 3, False, 0.3)
_B14 = _BROWS + _BINS_CTE + _tree_sql(0, 2, False, 0.3) + _tree_sql(1, 2, False, 0.3)
_B14C = _CROWS + _BINS_CTE + _tree_sql(0, 2, True, 0.3) + _tree_sql(1, 2, True, 0.3)


def b17(spark, d):
    """Weights of the encoding summed by column; each distinct value is encoded once."""
    long = _long(spark, d)
    enc = long.groupBy("feature", "v").count().join(F.broadcast(B.quantile_edges(long, 8, few_rule=False)), "feature")
    told = enc.select("feature", "count", F.posexplode(B.piecewise_linear(F.col("v"), F.col("edges"))).alias("k", "w"))
    return told.groupBy("feature", "k").agg(F.round(F.sum(F.col("w").cast("decimal(18,8)") * F.col("count").cast("decimal(15,0)")).cast("double"), 3).alias("w"), F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("count"))), F.lit(0)).alias("n"))


def b20(spark, d):
    e = B.quantile_edges(_long(spark, d), 4, few_rule=False)
    return e.select("feature", F.posexplode(B.densified(F.col("edges"), 2)).alias("k", "edge"))


def b23(spark, d):
    return B.quantile_edges(_long(spark, d), BINS).agg(F.sum(F.size("edges")).alias("width"), (F.count("*") * (BINS + 1)).alias("nominal"))


_STOPS = [(0.0, 10, 20, 80), (0.3, 40, 90, 200), (0.5, 240, 220, 130), (0.8, 60, 140, 40), (1.0, 255, 255, 255)]


def b25(spark, d):
    p = load(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("v"))
    return p.select("p_partkey", B.colour_ramp(F.col("v"), _STOPS).alias("c")).select("p_partkey", "c.r", "c.g", "c.b")


def _ramp(k: int) -> str:
    arms = " ".join(f"WHEN v < {b[0]}::DOUBLE THEN {a[k]} + ({b[k] - a[k]}) * (v - {a[0]}::DOUBLE) / {b[0] - a[0]!r}::DOUBLE" for a, b in zip(_STOPS, _STOPS[1:], strict=False))
    return f"trunc(CASE {arms} ELSE {_STOPS[-1][k]} END)::INT"


def g01(spark, d):
    c = load(spark, d, "lineitem").groupBy("l_linestatus", "l_returnflag").count()
    return c.groupBy("l_linestatus").agg(F.round(1 - F.sum(F.col("count") * F.col("count")) / F.pow(F.sum("count"), 2), 9).alias("gini"))


def g02(spark, d):
    c = load(spark, d, "lineitem").groupBy((F.col("l_quantity") <= 25).alias("left"), "l_returnflag").count()
    side = c.groupBy("left").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("q"))
    whole = c.groupBy("l_returnflag").agg(F.sum("count").alias("c")).agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("tq"))
    return side.join(F.broadcast(whole)).groupBy("t", "tq").agg(F.sum(F.col("n") / F.col("t") * (1 - F.col("q") / (F.col("n") * F.col("n")))).alias("k")).select(F.round(1 - F.col("tq") / (F.col("t") * F.col("t")) - F.col("k"), 9).alias("gain"))


def m03(spark, d):
    rows = _forest_rows(spark, d)
    at = rows.withColumn("node", F.lit(1).cast("bigint"))
    return forest.best_split(at, forest.drawn_thresholds(forest.bounds(at), 42), "classification").select("tree", "feature", F.round("threshold", 6).alias("threshold"), F.round("gain", 7).alias("gain"))


def _forest_rows(spark, d, trees: int = 3) -> DataFrame:
    """One row for each order and tree: whole quantity, largest price and tax, and whether a line was returned."""
    line = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"), F.max("l_tax").alias("t"), F.max("l_returnflag").alias("f"))
    x = F.array(*(F.col(c).cast("double") for c in ("q", "p", "t")))
    y = F.when(F.col("f") == "R", 1).otherwise(0)
    return line.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.col("l_orderkey").alias("key"), x.alias("x"), y.alias("y"), F.lit(1).alias("weight"))


_FROWS = "fo AS (SELECT l_orderkey AS key, sum(l_quantity) AS q, max(l_extendedprice) AS p, max(l_tax) AS t, CASE WHEN max(l_returnflag) = 'R' THEN 1 ELSE 0 END AS y FROM lineitem GROUP BY 1), fl AS (SELECT tree, key, y, unnest([0, 1, 2]) AS feature, unnest([q, p, t]) AS v FROM fo, range(3) t(tree)), fb AS (SELECT tree, feature, min(v) AS lo, max(v) AS hi FROM fl GROUP BY ALL), ft AS (SELECT tree, feature, lo + " + uniform_sql(42, "tree", "1", "feature") + " * (hi - lo) AS threshold FROM fb WHERE hi > lo)"
_M03 = f"WITH {_FROWS}, c AS (SELECT tree, feature, threshold, y, count(*) FILTER (v <= threshold) AS l, count(*) AS a FROM fl JOIN ft USING (tree, feature) GROUP BY ALL), s AS (SELECT tree, feature, threshold, sum(l) AS nl, sum(a) AS n, sum(l * l) AS ll, sum((a - l) * (a - l)) AS rr, sum(a * a) AS aa FROM c GROUP BY ALL), g AS (SELECT *, round(1 - aa / (n * n) - nl / n * (1 - ll / (nl * nl)) - (n - nl) / n * (1 - rr / ((n - nl) * (n - nl))), 9) AS gain FROM s WHERE nl > 0 AND n > nl) SELECT tree::INT AS tree, feature::INT AS feature, round(threshold, 6) AS threshold, round(gain, 7) AS gain FROM g QUALIFY row_number() OVER (PARTITION BY tree ORDER BY gain DESC, feature) = 1"


def m04(spark, d):
    at = _forest_rows(spark, d).withColumn("node", F.lit(1).cast("bigint"))
    return forest.random_split(forest.bounds(at), 42).select("tree", "feature", F.round("threshold", 6).alias("threshold"))


def m05(spark, d):
    n = forest.grow(_forest_rows(spark, d), depth=3, seed=42)
    return n.select("tree", "node", "depth", "feature", F.round("threshold", 6).alias("threshold"), "n")


def m06(spark, d):
    n = forest.grow(_forest_rows(spark, d, 2), depth=3, seed=42, split="mondrian", task="regression", lifetime=1.0)
    return n.select("tree", "node", "depth", "feature", F.round("threshold", 6).alias("threshold"), "n", F.round("mean", 6).alias("mean"))


def m10(spark, d):
    o = load(spark, d, "orders").select("o_orderkey").distinct()
    return forest.bootstrap(o, "o_orderkey", 2, 42)


def m11(spark, d):
    return forest.subsample(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3, 256, 42)


def m12(spark, d):
    rows = _forest_rows(spark, d, 1).drop("tree", "weight")
    boot = forest.bootstrap(rows.select("key"), "key", 4, 42)
    nodes = forest.grow(boot.join(rows, "key").select("tree", "key", "x", "y", "weight"), depth=4, seed=42)
    return forest.predict_class(rows, nodes, 4, "key")


def m14(spark, d):
    nodes = forest.grow(_forest_rows(spark, d), depth=3, seed=42)
    return forest.predict_shares(_forest_rows(spark, d, 1).drop("tree"), nodes, 3, "key")


def m16(spark, d):
    ev = load(spark, d, "events").select(F.col("event_id").alias("key"), F.array(F.col("value"), F.hour("ts").cast("double")).alias("x"))
    pick = forest.subsample(ev.select("key"), "key", 5, 256, 42)
    nodes = forest.grow(pick.join(ev, "key").withColumns({"y": F.lit(0.0), "weight": F.lit(1)}), depth=8, seed=42, split="random", task="regression")
    return forest.anomaly_scores(ev, nodes, 8, "key", 256)


def m25(spark, d):
    nodes = forest.grow(_forest_rows(spark, d), depth=3, seed=42)
    return forest.leaves(_forest_rows(spark, d, 1).select("key", "x"), nodes, 3).join(F.broadcast(forest.leaf_ranks(nodes)), ["tree", "node"]).select("key", "tree", (F.col("tree") * 8 + F.col("rank")).alias("column"))


def m36(spark, d):
    """Exact split: the first quarter of each return flag by hash is for validation."""
    line = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", uniform(36, "o_orderkey").alias("u"))
    n = line.groupBy("o_orderstatus").agg(F.greatest(F.lit(1), F.floor(F.count("*") * 0.25)).alias("m"))
    return sampling.ranked(line, ["o_orderstatus"], "u", "o_orderkey", "r").join(F.broadcast(n), "o_orderstatus").select("o_orderkey", (F.col("r") <= F.col("m")).alias("validation"))


def m40(spark, d):
    """Accuracy, AUC by average ranks, and squared error of quantity as a score for large prices."""
    s = load(spark, d, "lineitem").select((F.col("l_extendedprice") > 40000).cast("int").alias("y"), F.col("l_quantity").alias("s"))
    c = s.groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    w = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = c.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))  # one row for each distinct score
    a = ranked.agg(F.sum("p").alias("pos"), F.sum("n").alias("all"), F.sum(F.col("p") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r"))
    auc = a.select(F.round((F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * (F.col("all") - F.col("pos"))), 9).alias("auc"))
    rest = s.agg(F.round(F.avg(((F.col("s") > 25).cast("int") == F.col("y")).cast("int")), 9).alias("accuracy"), F.round(F.avg(F.pow(F.col("s") - F.col("y"), 2)), 6).alias("mse"))
    return auc.join(F.broadcast(rest))


_FO = "WITH fo AS (SELECT l_orderkey AS key, sum(l_quantity) AS q, max(l_extendedprice) AS p, max(l_tax) AS t, CASE WHEN max(l_returnflag) = 'R' THEN 1 ELSE 0 END AS y FROM lineitem GROUP BY 1), fv AS (SELECT key, unnest([0, 1, 2]) AS feature, unnest([q, p, t]) AS v FROM fo), "
_FR = "fr AS (SELECT tree, key, 1 AS weight, y FROM fo, range({0}) t(tree)), "
_DEEP = _FO + _FR.format(3) + S.grown(3)
_BAG = f"bn AS (SELECT count(*) AS n FROM fo), bi AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i_of FROM fo), bd AS (SELECT tree, floor({uniform_sql(42, 'tree', 'draw')} * n)::BIGINT AS i FROM bn, range(4) t(tree), unnest(range(n)) AS u(draw)), bw AS (SELECT tree, i, count(*) AS weight FROM bd GROUP BY ALL), fr AS (SELECT t.tree AS tree, key, coalesce(weight, 0) AS weight, y FROM range(4) t(tree) CROSS JOIN (fo JOIN bi USING (key)) LEFT JOIN bw ON bw.tree = t.tree AND bw.i = i_of), "
_EVENTS = f"WITH ev AS (SELECT event_id AS key, value, hour(ts)::DOUBLE AS h FROM events), fv AS (SELECT key, unnest([0, 1]) AS feature, unnest([value, h]) AS v FROM ev), fr AS (SELECT tree, key, (row_number() OVER (PARTITION BY tree ORDER BY {uniform_sql(42, 'tree', 'key')}, key) <= 256)::INT AS weight, 0 AS y FROM ev, range(5) t(tree)), "
#: Brackets of a value over edges: shares of the two ends of the first one of some width that holds it, one at an end outside.
_ENCODED = f"""WITH {_LONG}, {_QEDGES.replace(f"range({BINS})", "range(8)").replace(f"/ {BINS}.0", "/ 8.0")},
el AS (SELECT feature, (k - 1) AS k, edges[k] AS lo, edges[k + 1] AS hi, len(edges) AS m FROM qedges, unnest(range(1, len(edges) + 1)) AS u(k)),
ex AS (SELECT feature, v, count(*) AS c FROM long GROUP BY ALL),
inside AS (SELECT feature, v, c, m, k, (hi - v) / (hi - lo) AS a, (v - lo) / (hi - lo) AS b FROM ex JOIN el USING (feature) WHERE hi > lo AND v >= lo AND v <= hi QUALIFY row_number() OVER (PARTITION BY feature, v ORDER BY k) = 1),
share AS (SELECT feature, k, c, a AS w FROM inside UNION ALL SELECT feature, k + 1, c, b FROM inside
  UNION ALL SELECT feature, CASE WHEN v < min(lo) OR NOT bool_or(coalesce(hi > lo, false)) THEN 0 ELSE any_value(m) - 1 END, c, 1.0 FROM ex JOIN el USING (feature) WHERE (feature, v) NOT IN (SELECT (feature, v) FROM inside) GROUP BY feature, v, c)
SELECT feature, el.k::INT AS k, round(coalesce(sum(w::DECIMAL(20,8) * c), 0)::DOUBLE, 3) AS w, coalesce(sum(c) FILTER (w > 0), 0)::BIGINT AS n FROM el LEFT JOIN share USING (feature, k) GROUP BY ALL"""
_MIDDLES = "list_sort(list_distinct(list_concat({0}, list_transform(range(1, len({0})), lambda i: ({0}[i] + {0}[i + 1]) / 2))))"
_DENSE = f"""WITH {_LONG}, {_QEDGES.replace(f"range({BINS})", "range(4)").replace(f"/ {BINS}.0", "/ 4.0")},
one AS (SELECT feature, {_MIDDLES.format("edges")} AS e FROM qedges), two AS (SELECT feature, {_MIDDLES.format("e")} AS e FROM one)
SELECT feature, (k - 1)::INT AS k, e[k] AS edge FROM two, unnest(range(1, len(e) + 1)) AS u(k)"""


_CASES = {
    "b01": (b01, _WITH + "SELECT feature, bin, count(*) AS count FROM binned GROUP BY ALL"),
    "b02": (b02, f"WITH {_LONG}, {_QEDGES} SELECT feature, (k - 1)::INT AS k, edges[k] AS edge FROM qedges, unnest(range(1, len(edges) + 1)) AS u(k)"),
    "b03": (b03, "WITH e AS (SELECT o_custkey AS feature, list_append(list(DISTINCT o_totalprice ORDER BY o_totalprice), max(o_totalprice)) AS e FROM orders GROUP BY 1 HAVING count(*) <= 8) SELECT feature, (k - 1)::INT AS k, e[k] AS edge FROM e, unnest(range(1, len(e) + 1)) AS u(k)"),
    "b04": (lambda s, d: _quantile_bins(s, d).groupBy("feature", "bin").count(), f"WITH {_LONG}, {_QEDGES} SELECT feature, greatest(least(len(list_filter(edges, lambda e: e <= v)) - 1, len(edges) - 2), 0)::INT AS bin, count(*) AS count FROM long JOIN qedges USING (feature) GROUP BY ALL"),
    "b05": (b05, f"WITH {_LONG}, {_EDGES}, ue AS (SELECT feature, list_transform(range({BINS} + 1), lambda i: lo + i * ((hi - lo) / {BINS})) AS edges FROM edges) SELECT feature, greatest(least(len(list_filter(edges, lambda e: e <= v)) - 1, len(edges) - 2), 0)::INT AS bin, count(*) AS count FROM long JOIN ue USING (feature) GROUP BY ALL"),
    "b06": (b06, _WITH + "SELECT feature, bin, g::DOUBLE AS g, n::BIGINT AS h, n FROM hist"),
    "b07": (b07, _WITH + ", s AS (SELECT feature, bin, sum(g) OVER w::DOUBLE AS gl, sum(n) OVER w::DOUBLE AS nl, sum(g) OVER (PARTITION BY feature)::DOUBLE AS gt, sum(n) OVER (PARTITION BY feature)::DOUBLE AS nt FROM hist WINDOW w AS (PARTITION BY feature ORDER BY bin)), k AS (SELECT *, round(0.5 * (gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) - gt * gt / nt), 3) AS gain FROM s WHERE nl >= 20 AND nt - nl >= 20) SELECT feature, bin, gain, nl::BIGINT AS n_left, (nt - nl)::BIGINT AS n_right FROM k ORDER BY gain DESC, feature, bin LIMIT 1"),
    "b08": (lambda s, d: b06(s, d).select("feature", "bin", F.round(B.leaf_value(F.col("g"), F.col("h")), 9).alias("value")), _WITH + "SELECT feature, bin, round(-(g::DOUBLE) / n, 9) AS value FROM hist"),
    "b10": (b10, "SELECT l_returnflag AS class, round(p - 1, 9) AS g_own, round(p, 9) AS g_other, round(greatest(p * (1 - p), 1e-15), 9) AS h, round(ln(p), 9) AS init FROM (SELECT l_returnflag, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 1)"),
    "b11": (b11, "SELECT o_orderkey, round((SELECT sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) FROM orders) - o_totalprice, 4) AS g, 1 AS h FROM orders"),
    "b13": (b13, f"WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS part, {uniform_sql(13, 'o_orderkey')} AS u FROM orders) SELECT o_orderkey FROM o QUALIFY row_number() OVER (PARTITION BY part ORDER BY u, o_orderkey) <= greatest(1, floor(count(*) OVER (PARTITION BY part) * 0.5))"),
    "b09": (b09, _B09 + " SELECT node, feature, bin, gain, n, value FROM n0"),
    "m46": (m46, _B09 + " SELECT key AS l_orderkey, value FROM v0"),
    "b14": (b14, _B14 + "".join(f" {'UNION ALL' if k else ''} SELECT {k} AS tree, node, feature, bin, n, value FROM n{k}" for k in (0, 1))),
    "b15": (b15, _B14 + " SELECT key AS l_orderkey, pred FROM p2"),
    "b14_classes": (b14_classes, _B14C + "".join(f" {'UNION ALL' if k else ''} SELECT {k} AS round, class, node, feature, bin, n, floor(value * 1000 + 0.5::DOUBLE) / 1000 AS value FROM n{k}" for k in (0, 1))),
    "b15_classes": (b15_classes, _B14C + ", f AS (SELECT key, class, pred, exp(pred) / sum(exp(pred)) OVER (PARTITION BY key) AS p FROM p2) SELECT key AS l_orderkey, arg_min(class, (-pred, class))::INT AS predicted, " + ", ".join(f"floor(max(p) FILTER (class = {k}) * 1000 + 0.5::DOUBLE) / 1000 AS p{k}" for k in range(3)) + " FROM f GROUP BY key"),
    "b17": (b17, _ENCODED),
    "b20": (b20, _DENSE),
    "b23": (b23, f"WITH {_LONG}, {_QEDGES} SELECT sum(len(edges))::BIGINT AS width, (count(*) * {BINS + 1})::BIGINT AS nominal FROM qedges"),
    "b24": (lambda s, d: load(s, d, "part").select("p_partkey", B.threshold_class(F.col("p_size") / 50, [0.2, 0.4, 0.5, 0.7, 0.9], ["deep", "shallow", "coast", "grass", "hill", "peak"]).alias("terrain")), "SELECT p_partkey, CASE WHEN p_size / 50 < 0.2 THEN 'deep' WHEN p_size / 50 < 0.4 THEN 'shallow' WHEN p_size / 50 < 0.5 THEN 'coast' WHEN p_size / 50 < 0.7 THEN 'grass' WHEN p_size / 50 < 0.9 THEN 'hill' ELSE 'peak' END AS terrain FROM part"),
    "b25": (b25, f"SELECT p_partkey, {_ramp(1)} AS r, {_ramp(2)} AS g, {_ramp(3)} AS b FROM (SELECT p_partkey, p_size / 50 AS v FROM part)"),
    "g01": (g01, "SELECT l_linestatus, round(1 - sum(n * n) / pow(sum(n), 2), 9) AS gini FROM (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1"),
    "g02": (g02, "WITH c AS (SELECT l_quantity <= 25 AS l, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT l, sum(n) AS n, sum(n * n) AS q FROM c GROUP BY l), t AS (SELECT sum(c) AS t, sum(c * c) AS tq FROM (SELECT f, sum(n) AS c FROM c GROUP BY f)) SELECT round(1 - max(tq) / (max(t) * max(t)) - sum(n / t * (1 - q / (n * n))), 9) AS gain FROM s, t"),
    "g03": (lambda s, d: load(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.coalesce(F.var_pop("l_quantity"), F.lit(0.0)), 6).alias("v")), "SELECT l_returnflag, round(var_pop(l_quantity), 6) AS v FROM lineitem GROUP BY 1"),
    "g04": (lambda s, d: _long(s, d).groupBy("y", "feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), f"WITH {_LONG} SELECT y, feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY ALL"),
    "g05": (lambda s, d: load(s, d, "lineitem").groupBy("l_orderkey").agg((F.min("l_returnflag") == F.max("l_returnflag")).alias("same"), (F.min("l_quantity") == F.max("l_quantity")).alias("same_q")), "SELECT l_orderkey, min(l_returnflag) = max(l_returnflag) AS same, min(l_quantity) = max(l_quantity) AS same_q FROM lineitem GROUP BY 1"),
    "g06": (lambda s, d: load(s, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().fillna(0), "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1"),
    "g15": (lambda s, d: load(s, d, "lineitem").agg(F.round(F.avg((F.col("l_returnflag") == "N").cast("int")), 9).alias("accuracy"), F.round(F.avg(F.pow(F.col("l_quantity") - 25, 2)), 6).alias("mse")), "SELECT round(avg((l_returnflag = 'N')::INT), 9) AS accuracy, round(avg(pow(l_quantity - 25, 2)), 6) AS mse FROM lineitem"),
    "g17": (lambda s, d: load(s, d, "events").groupBy("event_type").agg(F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / F.count("*"), 4).alias("mean"), F.count("*").alias("n")), "SELECT event_type, round(sum(value::DECIMAL(18,6))::DOUBLE / count(*), 4) AS mean, count(*) AS n FROM events GROUP BY 1"),
    "m01": (lambda s, d: load(s, d, "lineitem").groupBy("l_orderkey").count().select("l_orderkey", F.round(forest.average_path(F.col("count")), 9).alias("c")), "SELECT l_orderkey, round(CASE WHEN n <= 1 THEN 0.0::DOUBLE WHEN n = 2 THEN 1.0 ELSE 2.0::DOUBLE * (ln(greatest(n, 3) - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * (n - 1) / n END, 9) AS c FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)"),
    "m03": (m03, _M03),
    "m04": (m04, f"WITH {_FROWS} SELECT tree::INT AS tree, feature::INT AS feature, round(threshold, 6) AS threshold FROM ft QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {uniform_sql(43, 'tree', '1', 'feature')}, feature) = 1"),
    "m05": (m05, _DEEP + "SELECT tree::INT AS tree, node::BIGINT AS node, depth, feature::INT AS feature, round(threshold, 6) AS threshold, n::BIGINT AS n FROM nd"),
    "m06": (m06, _FO + _FR.format(2) + S.grown(3, split="mondrian", lifetime=1.0) + "SELECT tree::INT AS tree, node::BIGINT AS node, depth, feature::INT AS feature, round(threshold, 6) AS threshold, n::BIGINT AS n, round(mean, 6) AS mean FROM nd"),
    "m10": (m10, f"WITH o AS (SELECT DISTINCT o_orderkey FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM o), n AS (SELECT count(*) AS n FROM o), dr AS (SELECT tree, floor({uniform_sql(42, 'tree', 'dd')} * n)::BIGINT AS i FROM n, range(2) t(tree), unnest(range(n)) AS u(dd)) SELECT tree::INT AS tree, o_orderkey, count(*) AS weight FROM dr JOIN r USING (i) GROUP BY ALL"),
    "m11": (m11, f"SELECT tree::INT AS tree, o_orderkey FROM orders, range(3) t(tree) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {uniform_sql(42, 'tree', 'o_orderkey')}, o_orderkey) <= 256"),
    "m12": (m12, _FO + _BAG + S.grown(4) + "SELECT key, CASE WHEN round(sum(mean) / 4, 9) > round(sum(1 - mean) / 4, 9) THEN 1 ELSE 0 END AS predicted FROM leaf JOIN nd USING (tree, node) GROUP BY key"),
    "m13": (lambda s, d: load(s, d, "lineitem").join(F.broadcast(load(s, d, "lineitem").select("l_returnflag").distinct().withColumn("class", F.dense_rank().over(Window.orderBy("l_returnflag")) - 1)), "l_returnflag").groupBy("l_orderkey", "class").count(), "SELECT l_orderkey, (dr - 1)::INT AS class, count(*) AS count FROM (SELECT l_orderkey, dense_rank() OVER (ORDER BY l_returnflag) AS dr FROM lineitem) GROUP BY ALL"),
    "m14": (m14, _DEEP + ", p AS (SELECT key, class, CASE class WHEN 1 THEN mean ELSE 1 - mean END AS p FROM leaf JOIN nd USING (tree, node), range(2) c(class)) SELECT key, class::INT AS class, round(sum(p) / 3, 9) AS p FROM p GROUP BY ALL HAVING sum(p) > 0"),
    "m16": (m16, _EVENTS + S.grown(8, split="random", task="regression") + f"SELECT key, round(pow(2, -avg(depth + {S.AVERAGE_PATH.format('n')}) / ({S.AVERAGE_PATH.format('256')})), 6) AS score FROM leaf JOIN nd USING (tree, node) GROUP BY key"),
    "m25": (m25, _DEEP + ", lr AS (SELECT tree, node, row_number() OVER (PARTITION BY tree ORDER BY rpad(bin(node), 64, '0'), depth) - 1 AS rank FROM nd WHERE feature IS NULL) SELECT key, tree::INT AS tree, (tree * 8 + rank)::INT AS column FROM leaf JOIN lr USING (tree, node)"),
    "m36": (m36, f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {uniform_sql(36, 'o_orderkey')}, o_orderkey) <= greatest(1, floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.25)) AS validation FROM orders"),
    "m40": (m40, "WITH s AS (SELECT (l_extendedprice > 40000)::INT AS y, l_quantity AS s FROM lineitem), r AS (SELECT y, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM s) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) AS auc, round(avg(((s > 25)::INT = y)::INT), 9) AS accuracy, round(avg(pow(s - y, 2)), 6) AS mse FROM r"),
}

QUERIES = {k: f for k, (f, _) in _CASES.items()}
SQL = {k: sql for k, (_, sql) in _CASES.items() if sql}
