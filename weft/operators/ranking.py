"""Top-k, retention, first-of-group and tag scores, all with explicit tie-breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as X


def top_by(df: DataFrame, by: list[str], ties: list[str], n: int) -> DataFrame:
    """The n rows with the largest `by`, nulls last, ties to the smaller keys (a take-ordered, no full sort)."""
    return df.orderBy(*(F.desc_nulls_last(c) for c in by), *ties).limit(n)


def newest(df: DataFrame, group: list[str], by: list[str], n: int) -> DataFrame:
    """The last n rows of each group (groups are cut before the shuffle)."""
    w = Window.partitionBy(*group).orderBy(*(F.desc(c) for c in by))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group of equal keys."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest))


#: Tags that go to the rows of documents; more are joined by word, without the texts.
BROADCAST_TAGS = 100_000


def tag_scores(docs: DataFrame, tags: DataFrame, key: str, text: str = "text", broadcast_tags: int = BROADCAST_TAGS) -> DataFrame:
    """(key, score): for each of the tags among a text's words 1 and half its occurrences (2 at most), and 2 for each
    neighbouring pair of a tag's words that are neighbours in the text.

    Distinct words and pairs of a text meet the tags by equality, without the text; the texts then join their own tags, and
    occurrences are counted for those. Keys are unique.
    """
    tags = tags.select("tag").where("tag IS NOT NULL AND tag <> ''").distinct()
    pairs = tags.select(F.explode(X.neighbours(F.col("tag"))).alias("pair")).groupBy("pair").agg((F.count("*") * 2.0).alias("score"))
    few = tags.limit(broadcast_tags + 1).count() <= broadcast_tags
    low = F.lower(text)
    times = lambda t, of: F.floor((F.length(of) - F.length(F.replace(of, t, F.lit("")))) / F.length(t))
    words = F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)))).alias("tag")
    if few:
        # tags come to the texts, which stay where they are; only what meets a tag goes on
        met = docs.select(key, F.col(text).alias("_text"), words).join(F.broadcast(tags), "tag")
        hits = met.select(key, (1.0 + F.least(times(F.col("tag"), F.lower("_text")) * 0.5, F.lit(2.0))).alias("score"))
    else:
        met = docs.select(key, words).join(tags, "tag").groupBy(key).agg(F.collect_list("tag").alias("_met"))
        hits = docs.select(key, low.alias("_low")).join(met, key).select(key, F.aggregate("_met", F.lit(0.0), lambda s, t: s + 1.0 + F.least(times(t, F.col("_low")) * 0.5, F.lit(2.0))).alias("score"))
    small = F.broadcast if few else lambda df: df
    # neighbours as two columns: texts' own pairs are never written as strings
    ends = pairs.select(F.split_part("pair", F.lit("_"), F.lit(1)).alias("first"), F.split_part("pair", F.lit("_"), F.lit(2)).alias("second"), "score")
    if few and not pairs.limit(1).count():
        return docs.select(key, F.lit(0.0).alias("score")).unionByName(hits).groupBy(key).agg(F.sum("score").alias("score"))
    runs = docs.select(key, F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)).alias("_words"))
    both = F.explode(F.arrays_zip(F.col("_words").alias("first"), F.slice("_words", 2, 1 << 30).alias("second"))).alias("p")
    paired = runs.select(key, both).select(key, "p.first", "p.second").join(small(ends), ["first", "second"]).distinct().select(key, "score")
    return docs.select(key, F.lit(0.0).alias("score")).unionByName(hits).unionByName(paired).groupBy(key).agg(F.sum("score").alias("score"))
