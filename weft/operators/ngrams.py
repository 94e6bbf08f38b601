"""Interpolated Kneser-Ney n-gram model as tables of counts; contexts are arrays of words.

counts (n, ctx, word, c) hold raw counts of orders 1..N; the model joins each token with its orders' numerators and
denominators, bottom-up, so that scoring is `order` equi-joins and no recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.storage import materialise


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def ngram_counts(sentences: DataFrame, order: int, words: str = "words") -> DataFrame:
    """(n, ctx, word, c) of sliding n-grams of all orders within sentences."""
    w = F.col(words)

    def grams(n: int) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.size(w))
        return F.transform(places, lambda i: F.struct(F.lit(n).alias("n"), F.slice(w, i, n - 1).alias("ctx"), F.get(w, i + n - 2).alias("word")))

    return sentences.select(F.explode(F.concat(*(grams(n) for n in range(1, order + 1)))).alias("g")).groupBy("g.n", "g.ctx", "g.word").agg(F.count("*").alias("c"))


def continuation_counts(counts: DataFrame) -> DataFrame:
    """(n, ctx, word, c): of how many distinct words to the left an n-gram is the rest."""
    longer = counts.where(F.col("n") >= 2)
    return longer.groupBy((F.col("n") - 1).alias("n"), F.slice("ctx", 2, F.greatest(F.size("ctx") - 1, F.lit(0))).alias("ctx"), "word").agg(F.count("*").alias("c"))


def context_totals(counts: DataFrame) -> DataFrame:
    """(n, ctx, total, followers)."""
    return counts.groupBy("n", "ctx").agg(F.sum("c").alias("total"), F.count("*").alias("followers"))


def vocabulary(sentences: DataFrame, words: str = "words") -> DataFrame:
    """Distinct words and <UNK>."""
    return sentences.select(F.explode(words).alias("word")).union(sentences.sparkSession.sql("SELECT '<UNK>' AS word")).distinct()


def scored(tokens: DataFrame, counts: DataFrame, order: int, discount: float = 0.1) -> DataFrame:
    """tokens (id, ctx, word) with p, the interpolated probability; contexts longer than order - 1 are cut to their end.

    The top order takes raw counts, lower orders continuation counts; gamma takes followers of raw counts.
    """
    # counted once, and not again for each table of each order; tables of counts grow with the text, and so are joined by
    # merging: compressed, they look small enough for the driver when they aren't
    counts = materialise(counts)
    cont = materialise(continuation_counts(counts))
    distinct = counts.where(F.col("n") == 1).agg((F.count("*") + 1).alias("_v"))
    uni = cont.where(F.col("n") == 1)
    types = uni.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("_types"))
    out = tokens.withColumn("ctx", F.slice("ctx", F.greatest(F.size("ctx") - (order - 2), F.lit(1)), order - 1) if order > 1 else F.expr("cast(array() as array<string>)"))
    out = out.join(uni.select("word", F.col("c").alias("_c1")).hint("merge"), "word", "left").join(F.broadcast(distinct)).join(F.broadcast(types))
    out = out.withColumn("p", F.when(F.col("_types") > 0, F.coalesce("_c1", F.lit(0)) / F.col("_types")).otherwise(1 / F.col("_v"))).drop("_c1", "_v", "_types")
    for n in range(2, order + 1):
        raw = counts.where(F.col("n") == n)
        part = raw if n == order else cont.where(F.col("n") == n)
        has = F.size("ctx") >= n - 1
        key = F.when(has, F.slice("ctx", F.greatest(F.size("ctx") - (n - 2), F.lit(1)), n - 1))
        # one grouping for both: a context that is continued is one of raw counts, too
        both = part.select(F.col("ctx").alias("_k"), F.col("c").alias("_t"), F.lit(1 if n == order else 0).alias("followers"))
        if n < order:
            both = both.unionByName(raw.select(F.col("ctx").alias("_k"), F.lit(None).cast("bigint").alias("_t"), F.lit(1).alias("followers")))
        total = both.groupBy("_k").agg(F.sum("_t").alias("_t"), F.sum("followers").alias("followers")).where("_t IS NOT NULL")
        out = out.withColumn("_k", key).join(total.hint("merge"), "_k", "left").join(part.select(F.col("ctx").alias("_k"), "word", F.col("c").alias("_c")).hint("merge"), ["_k", "word"], "left")
        alpha = F.greatest(F.coalesce("_c", F.lit(0)) - discount, F.lit(0.0)) / F.col("_t")
        gamma = discount * F.coalesce("followers", F.lit(0)) / F.col("_t")
        out = out.withColumn("p", F.when(has & F.col("_t").isNotNull(), alpha + gamma * F.col("p")).otherwise(F.col("p"))).drop("_k", "_t", "_c", "followers")
    return out


def token_contexts(sentences: DataFrame, order: int, key: str, words: str = "words") -> DataFrame:
    """(key, pos, ctx, word): each token with the words before it in its sentence."""
    w = F.col(words)
    rows = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: i <= F.size(w)), lambda i: F.struct(i.alias("pos"), F.slice(w, F.greatest(i - (order - 1), F.lit(1)), F.least(i - 1, F.lit(order - 1))).alias("ctx"), F.get(w, i - 1).alias("word")))
    return sentences.select(key, F.explode(rows).alias("t")).select(key, "t.*")


def perplexity(scores: DataFrame, key: str) -> DataFrame:
    """2 to the minus mean log2 probability of tokens with p > 0; infinite without any."""
    return scores.groupBy(key).agg(F.coalesce(F.pow(F.lit(2.0), -F.avg(F.when(F.col("p") > 0, F.log2("p")))), F.lit(float("inf"))).alias("perplexity"))


def flat_index(ids: Column, size: Column | int) -> Column:
    """Base-V number of an id sequence."""
    return F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a * size + x)
