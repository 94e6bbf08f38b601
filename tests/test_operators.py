"""Properties and small cases of operators that SQL doesn't check."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weft.functions import markup
from weft.functions import text as X
from weft.operators import attribution, binning, boosting, forest, grids, heightmaps, ngrams
from weft.streaming import events


def test_kneser_ney_sums_to_one(spark):
    s = spark.createDataFrame([(1, "the cat sat".split()), (2, "the dog ran".split())], "id long, words array<string>")
    counts = ngrams.ngram_counts(s, 2)
    vocabulary = ["the", "cat", "sat", "dog", "ran", "<UNK>"]
    for ctx in ([], ["the"], ["cat"], ["dog"]):
        tokens = spark.createDataFrame([(w, ctx) for w in vocabulary], "word string, ctx array<string>")
        p = {r.word: r.p for r in ngrams.scored(tokens, counts, 2, 0.1).collect()}
        assert abs(sum(p.values()) - 1) < 0.01 and p["cat"] == p["dog"]
        if ctx == ["the"]:
            assert abs(p["cat"] - 0.475) < 1e-9


def test_kneser_ney_counts_once_and_keeps_counts_off_the_driver(spark):
    s = spark.createDataFrame([(1, "the cat sat".split()), (2, "the dog ran".split())], "id long, words array<string>")
    tokens = ngrams.token_contexts(s, 3, "id")
    plan = ngrams.scored(tokens, ngrams.ngram_counts(s, 3), 3)._jdf.queryExecution().executedPlan().toString()
    # the sentences are taken apart for the tokens only, and no table of counts is broadcast, however small it looks
    assert plan.count("Generate explode") == 1 and "BroadcastHashJoin" not in plan


def test_small_heightmaps_equal_those_of_the_tables_of_cells(spark, monkeypatch):
    keys = spark.range(3).select(F.col("id").alias("map"))
    quick = heightmaps.heightmap(keys.union(keys), 20, 14, 31)
    plan = quick._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange ") == 1
    got = {(r.map, r.y, r.x): r.v for r in quick.collect()}
    monkeypatch.setattr(heightmaps, "ROW_CELLS", 0)
    monkeypatch.setattr(heightmaps, "BROADCAST_MAPS", 0)
    slow = heightmaps.heightmap(keys, 20, 14, 31)
    assert "BroadcastHashJoin" not in slow._jdf.queryExecution().executedPlan().toString()
    want = {(r.map, r.y, r.x): r.v for r in slow.collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 20 * 14
    assert max(abs(got[k] - want[k]) for k in got) < 1e-12


def test_joins_of_grids_broadcast_no_cells(spark):
    cells = spark.range(64).select((F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), (F.col("id") / 64).alias("v"))
    for df in (grids.downhill(cells), grids.descents(cells, 0.1, 8)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def random_tree(rng, features):
    nodes = []

    def grow(node, n, depth):
        if depth == 4 or n < 2 or rng.random() < 0.2:
            nodes.append({"node": node, "feature": None, "threshold": None, "n": n, "value": rng.uniform(-10, 10)})
            return
        left = rng.randint(1, n - 1)
        nodes.append({"node": node, "feature": rng.randrange(features), "threshold": rng.uniform(-1, 1), "n": n, "value": None})
        grow(2 * node, left, depth + 1)
        grow(2 * node + 1, n - left, depth + 1)

    grow(1, rng.randint(20, 200), 0)
    return nodes


def test_shapley_values_same_as_brute_force():
    rng = random.Random(7)
    for _ in range(40):
        m = rng.randint(1, 4)
        nodes = random_tree(rng, m)
        x = np.array([[rng.uniform(-1.5, 1.5) for _ in range(m)] for _ in range(5)])
        assert np.allclose(attribution.tree_shap(x, nodes), attribution.brute_shap(x, nodes), atol=1e-8)


def test_forest_learns_and_explains(spark):
    rows = spark.createDataFrame([(k, [float(k), float(k % 7)], float(k > 50) * 4 + 1) for k in range(100)], "key long, x array<double>, y double")
    from pyspark.sql import functions as F

    nodes = forest.grow(rows.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("tree"), "key", "x", "y", F.lit(1).alias("weight")), depth=6, seed=3, task="regression")
    out = forest.predict_mean(rows, nodes, 6, "key").join(rows, "key").toPandas()
    assert ((out.predicted - out.y) ** 2).mean() < 0.8
    phi = attribution.forest_shap(rows, nodes, "key", 2).groupBy("key").agg(F.sum("phi").alias("s")).join(forest.predict_mean(rows, nodes, 6, "key"), "key").toPandas()
    assert (phi.s - phi.predicted).abs().max() < 1e-5


def test_boosting_fits(spark):
    df = spark.createDataFrame([(k, float(k), float(k % 5), 3.0 * (k > 40)) for k in range(100)], "key long, a double, b double, y double")
    for strategy in ("uniform", "quantile"):
        rows = boosting.binned_features(df, "key", ["a", "b"], 16, strategy)
        base, model = boosting.fit_regression(rows, trees=4, depth=2, min_leaf=5, rate=0.8)
        out = boosting.predict_regression(rows, base, model, 4, 2, 0.8).toPandas()
        assert ((out.pred - out.y) ** 2).mean() < 0.2  # the step lies within a bin


def test_bins_and_encoding(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 5.0), (0, 10.0), (1, 3.0), (1, 3.0), (1, 3.0)], "feature int, v double")
    edges = binning.quantile_edges(df, 2, few_rule=False)
    from pyspark.sql import functions as F

    got = df.join(edges, "feature").select("feature", "v", binning.piecewise_linear(F.col("v"), F.col("edges")).alias("w")).collect()
    w = {(r.feature, r.v): r.w for r in got}
    assert w[0, 0.0][0] == 1 and w[0, 10.0][-1] == 1 and all(abs(sum(x) - 1) < 1e-12 for x in w.values())
    u = binning.uniform_edges(df, 4)
    assert {r.b for r in df.where("feature = 1").join(u, "feature").select(binning.uniform_bin(F.col("v"), F.col("lo"), F.col("hi"), 4).alias("b")).collect()} == {0}


def test_text_cases(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("---\nTitle: A\ntags: [x, \"y z\"]\ndate: 2026-05\n---\nBody",), ("no block",), (None,)], "raw string")
    rows = df.select(X.front_matter("raw").alias("m"), X.body("raw").alias("b")).collect()
    assert rows[0].m["title"] == "A" and rows[0].b == "\nBody" and rows[1].m is None and rows[2].m is None
    d = spark.createDataFrame([("2026-05-26",), ("2026-05",), ("not-a-date",)], "v string").select(X.parse_date("v").alias("d")).collect()
    assert [str(r.d) for r in d] == ["2026-05-26", "2026-05-01", "None"]
    page = markup.to_html("# T\n\ntext **b**\nmore\n\n```py\na < b\n```\n> q\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 1 |\n1. x")
    for part in ("<h1>T</h1>", "<p>text <strong>b</strong> more</p>", '<pre class="language-py"><code>a &lt; b\n</code></pre>', "<blockquote><p>q</p></blockquote>", "<tr><td>1</td><td>2</td></tr></table>", "<ol><li>x</li></ol>"):
        assert part in page
    assert spark.range(1).select(F.size(F.lit(None).cast("array<int>"))).count() == 1


def by_hand(text, width):
    out = []
    for rest in text.split("\n"):
        while len(rest) > width:
            fits = [k for k in range(1, width + 1) if rest[k] == " "]
            line = rest[: fits[-1]] if fits else rest[:width]
            out.append(line)
            rest = rest[len(line) :].lstrip(" ") if fits else rest[width:]
        out.append(rest)
    return out


def test_wrapped_lines(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é\n\r ") for _ in range(rng.randrange(60))) for _ in range(400)] + ["", " ", "   \n", "aaa    ", "x" * 50, "a\n\nb"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for width in (1, 3, 7, 20):
        got = df.select("t", markup.wrapped("t", width).alias("l")).collect()
        assert all(r.l == (None if r.t is None else by_hand(r.t, width)) for r in got)
    assert df.select(markup.wrapped("t", 0).alias("l")).where("size(l) > 0").count() == 0


def test_inline_marks(spark):
    cases = {"_soft_ a_b_c __x__": "<em>soft</em> a<em>b</em>c __x__", "**a*b** *c*": "<strong>a*b</strong> <em>c</em>", "_": "_", "**b** and *i*": "<strong>b</strong> and <em>i</em>", "`a**b**` ![x](/y.png)": '<code>a**b**</code> <img src="/y.png" alt="x">', "[n](/t)!": '<a href="/t">n</a>!', "2 * 3 [no] `": "2 * 3 [no] `", "": ""}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.inline_markup("t").alias("h")).collect()
    assert {r.t: r.h for r in got} == cases and {t: markup.inline(t) for t in cases} == cases


def test_streamed_fold(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    pd.DataFrame({"item": ["a", "a", "b"], "seq": [2, 1, 1], "delta": ["lo", "hel", "x"], "done": [False, False, False]}).to_parquet(folder / "1.parquet")
    pd.DataFrame({"item": ["b"], "seq": [2], "delta": ["final"], "done": [True]}).to_parquet(folder / "2.parquet")
    stream = spark.readStream.schema("item string, seq long, delta string, done boolean").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = events.fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [(r.item, r.text) for r in spark.sql("SELECT * FROM folded").collect()]
    assert ("a", "hello") in rows and rows[-1] == ("b", "final")


def test_shapley_by_factors_at_depth_eight():
    rng = np.random.default_rng(8)
    nodes, todo = [], [(1, 900.0)]
    while todo:
        node, n = todo.pop()
        if node.bit_length() > 8 or (node > 1 and rng.random() < 0.25):
            nodes.append({"node": node, "feature": None, "threshold": None, "n": n, "value": float(rng.normal())})
            continue
        nodes.append({"node": node, "feature": int(rng.integers(6)), "threshold": float(rng.normal()), "n": n, "value": 0.0})
        left = n * float(rng.uniform(0.05, 0.95))
        todo += [(2 * node, left), (2 * node + 1, n - left)]
    x = rng.normal(size=(25, 6))
    assert max(r["node"] for r in nodes).bit_length() == 9
    assert np.allclose(attribution.tree_shap(x, nodes), attribution.brute_shap(x, nodes), atol=1e-9)
