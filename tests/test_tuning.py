"""Sizes read off one growth are the forests grown alone; runs that can't work are left out; no prediction before a fit."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import attribution, forest, ranking, tuning


def made(spark, n, run=0, seed=1):
    r = random.Random(seed)
    rows = [(run, k, [r.random(), float(r.randrange(5))], round(r.random() * 10, 2)) for k in range(n)]
    return spark.createDataFrame(rows, "run int, key long, x array<double>, y double")


def test_sizes_equal_forests_grown_alone(spark):
    rows = made(spark, 60)
    sizes = [(1, 1), (2, 3), (3, 2)]
    got = tuning.predictions(rows, tuning.grown(rows, sizes, 7), sizes)
    assert got.count() == 180
    for t, k in sizes:
        alone = forest.grow(rows.select(F.explode(F.sequence(F.lit(0), F.lit(t - 1))).alias("tree"), "key", "x", "y", F.lit(1).alias("weight")), depth=k, seed=7, task="regression")
        want = {r.key: r.predicted for r in forest.predict_mean(rows, alone, k, "key").collect()}
        assert {r.key: r.predicted for r in got.where((F.col("trees") == t) & (F.col("depth") == k)).collect()} == want


def test_scores_by_hand_and_runs_without_rows(spark):
    rows = [(0, 1.0, True, 1, 1, 0.9), (0, 0.0, True, 1, 1, 0.4), (0, 1.0, True, 1, 1, 0.4), (0, 0.0, True, 1, 1, 0.1), (1, 1.0, True, 1, 1, 0.5), (2, 3.0, False, 1, 1, 1.0)]
    got = {r.run: r for r in tuning.scores(spark.createDataFrame(rows, "run int, y double, binary boolean, trees int, depth int, predicted double")).collect()}
    assert got[0].auc == pytest.approx(3.5 / 4) and got[0].accuracy == pytest.approx(0.75)
    assert got[1].auc is None and got[1].accuracy == 1.0
    assert (got[2].mse, got[2].accuracy, got[2].auc) == (4.0, None, None)
    few = made(spark, 40).unionByName(made(spark, 1, run=1)).withColumnRenamed("run", "dataset").withColumn("binary", F.lit(False))
    out = tuning.benchmarked(few, ["best"], [(1, 1)], [0, 1]).collect()
    assert [(r.dataset, r.runs) for r in out] == [(0, 2)]


def test_tuner_refits_the_best_and_refuses_to_predict_before(spark):
    rows = made(spark, 80).drop("run")
    tuner = tuning.Halving([(1, 1), (2, 2)])
    with pytest.raises(ValueError):
        tuner.predict(rows)
    predicted = {r.key: r.predicted for r in tuner.fit(rows).predict(rows).collect()}
    t, k = tuner.best
    alone = forest.grow(rows.select(F.explode(F.sequence(F.lit(0), F.lit(t - 1))).alias("tree"), "key", "x", "y", F.lit(1).alias("weight")), depth=k, seed=42, task="regression")
    assert predicted == {r.key: r.predicted for r in forest.predict_mean(rows, alone, k, "key").collect()}
    assert {p for *_, p in tuner.rungs(rows.limit(0))} == {1, 2}


def test_predictions_and_attributions_stay_where_the_rows_are(spark):
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 5)], float(k % 3)) for k in range(60)], "key long, x array<double>, y double").withColumn("run", F.lit(0))
    nodes = tuning.grown(rows, [(2, 2)], 42)
    for out in (tuning.predictions(rows, nodes, [(1, 1), (2, 2)]), forest.predict_mean(rows, nodes, 2, "key"), attribution.shap_arrays(rows, nodes, 2)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() % 60 == 0


def test_tags_come_to_the_texts(spark):
    docs = spark.createDataFrame([(1, "Asia and asia"), (2, None), (3, "none")], "id long, body string")
    out = ranking.tag_scores(docs, spark.createDataFrame([("asia",), (None,)], "tag string"), "id", "body")
    assert {r.id: r.score for r in out.collect()} == {1: 2.0, 2: 0.0, 3: 0.0}
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
