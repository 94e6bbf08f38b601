"""Full-text queries against SQLite's own full-text index."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from weft.operators import chat, search

WORDS = ["red", "green", "blue", "redder", "reddest", "grey", "tea", "team"]


def random_query(depth=3):
    kind = random.random()
    if depth == 0 or kind < 0.3:
        phrase = lambda: random.choice([random.choice(WORDS), f'"{random.choice(WORDS)} {random.choice(WORDS)}"'])
        return random.choice([phrase, phrase, lambda: random.choice(["re", "gre", "te"]) + "*", lambda: f'"{random.choice(WORDS)} {random.choice(["re", "te"])}"*', lambda: f"NEAR({phrase()} {phrase()} {phrase()}, {random.randint(0, 4)})", lambda: f"NEAR({phrase()} {phrase()})"])()
    if kind < 0.45:
        return " ".join(random.choice([*WORDS, '"red tea"', "NEAR(red blue, 1)"]) for _ in range(random.randint(2, 3)))
    a, b = random_query(depth - 1), random_query(depth - 1)
    return f"{random.choice([a, f'({a})'])} {random.choice(['AND', 'OR', 'NOT'])} {random.choice([b, f'({b})'])}"


@pytest.fixture(scope="module")
def texts():
    random.seed(11)
    return [(k, " ".join(random.choices(WORDS, k=random.randint(0, 14)))) for k in range(120)] + [(200, None), (201, ""), (202, "Red, TEA! red-blue")]


def test_same_as_a_full_text_index(spark, texts):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    con.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", texts)
    random.seed(12)
    queries = [random_query() for _ in range(150)]
    want = {(q, r) for q in queries for (r,) in con.execute("SELECT rowid FROM t WHERE t MATCH ?", (q,))}
    index = chat.tokens(spark.createDataFrame(texts, "id long, body string"), "id", "body")
    got = search.matches(spark.createDataFrame([(q, q) for q in queries], "q string, query string"), index, "q", "id")
    assert {(r.q, r.id) for r in got.collect()} == want and len(want) > 500


def test_ill_formed_queries_match_nothing(spark, texts):
    bad = ["", None, "AND", "red AND", "OR red", "(red", "red)", "red NOT", "NOT red", "()", "*", '""', "red AND (blue OR)", "-", "red -"]
    index = chat.tokens(spark.createDataFrame(texts, "id long, body string"), "id", "body")
    queries = spark.createDataFrame([(str(k), q) for k, q in enumerate(bad)] + [("fine", "tea")], "q string, query string")
    assert {r.q for r in search.matches(queries, index, "q", "id").collect()} == {"fine"}
    assert search.matches(queries.limit(0), index, "q", "id").count() == 0
    assert search.matches(queries, index.limit(0), "q", "id").count() == 0


def test_postfix(spark):
    rows = [("a b NOT c OR d", "a b & c NOT d OR"), ("a OR b AND c NOT d", "a b c d NOT AND OR"), ("(a OR b) AND NEAR(c d, 2)", "a b OR NEAR(c d, 2) AND")]
    df = spark.createDataFrame(rows, "q string, want string").withColumn("got", F.concat_ws(" ", search.postfix(F.col("q"))))
    assert all(r.got == r.want for r in df.collect())


def test_only_postings_that_are_asked_for_travel_and_long_phrases_are_whole(spark):
    long = " ".join(f"w{k}" for k in range(130))
    docs = spark.createDataFrame([(1, long), (2, long.replace("w64", "x")), (3, "w3 " + long), (4, "w3"), (4, "w3")], "id long, text string")
    index = chat.tokens(docs, "id", "text")
    queries = spark.createDataFrame([(1, f'"{long}"'), (2, "w3"), (3, "NEAR(w3 w64, 60)")], "q long, query string")
    assert {(r.q, r.id) for r in search.matches(queries, index, "q", "id").collect()} == {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 3)}
    phrases = spark.createDataFrame([(7, ["w3"], False, False)], "phrase long, words array<string>, open boolean, placed boolean")
    hits = search._phrase_hits(phrases, index, "id")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.id, r.start) for r in hits.collect()) == [(1, None), (2, None), (3, None), (4, None)]
