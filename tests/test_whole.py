"""Groups and inputs of any size are worked on as a whole."""

from weft.operators import ranking
from weft.plans import registry

SF = "/root/testdata/sf0.001"


def test_newest_of_a_tag_are_cut_before_they_are_collected(spark):
    df = registry.QUERIES["d11"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert all(len(r.newest.split(",")) == min(r.n, 20) for r in df.collect())


def test_tags_of_several_words_score_by_their_bigrams(spark):
    docs = spark.createDataFrame([(1, "In the Middle  East."), (2, "middle of the east"), (3, "the middle east, east africa"), (4, "asia and asia")], "doc_id long, text string")
    tags = spark.createDataFrame([("middle east",), ("middle east east",), ("asia",)], "tag string")
    assert {r.doc_id: r.score for r in ranking.tag_scores(docs, tags, "doc_id").collect()} == {1: 4.0, 2: 0.0, 3: 6.0, 4: 2.0}
    assert {r.score for r in ranking.tag_scores(docs, tags.limit(0), "doc_id").collect()} == {0.0}
