"""Seeded draws as pure functions of keys: dice, picks, shuffles, weighted tables, templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.randomness import below, uniform


def dice(expr: Column, seed: int, key: Column) -> Column:
    """The sum of a throw like d20, 3d6 or 2d4+3 (a plain number is itself)."""
    n = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(expr, r"^(\d*)d", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(1))
    sides = F.nullif(F.regexp_extract(expr, r"d(\d+)", 1), F.lit("")).cast("int")
    plus = F.coalesce(F.nullif(F.regexp_extract(expr, r"([+-]\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    thrown = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.floor(uniform(seed, key, i) * sides).cast("int") + 1)
    return F.when(sides.isNull(), F.regexp_extract(expr, r"^(\d+)$", 1).cast("int")).otherwise(thrown + plus)


def pick(items: Column, seed: int, *keys: Column) -> Column:
    """One of an array's elements."""
    return F.get(items, below(seed, F.size(items), *keys))


def ranked(df: DataFrame, group: list[str], u: str, ties: str, name: str, parts: int = 4096) -> DataFrame:
    """df with each row's place (from 1) in its group by u, a number in [0, 1), and ties.

    Ranges of u are counted, and places within a range start from the counts of the ranges before it: a task ranks one
    range of one group, not a group.
    """
    at = df.withColumn("_range", F.floor(F.col(u) * parts))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy(*group, "_range").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    starts = starts.select(*(F.col(c).alias(f"_{c}") for c in [*group, "_range"]), "_start")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, "_range"]))
    within = Window.partitionBy(*group, "_range").orderBy(u, ties)
    return at.join(starts, same).withColumn(name, F.col("_start") + F.row_number().over(within)).select(*df.columns, name)


def shuffled(df: DataFrame, group: list[str], seed: int, key: str) -> DataFrame:
    """df with place, a permutation of each group's rows."""
    return ranked(df.withColumn("_u", uniform(seed, key)), group, "_u", key, "place").drop("_u")


def cumulated(items: DataFrame, table: str, pos: str, item: str, weight: str) -> DataFrame:
    """(table, items): each lookup table as one array of (upto, item) in its order; lookup tables are short lists."""
    w = Window.partitionBy(table).orderBy(pos)
    return items.withColumn("upto", F.sum(weight).over(w)).groupBy(table).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), "upto", F.col(item).alias("item")))).alias("items"))


def weighted_draw(items: Column, u: Column) -> Column:
    """The first item whose cumulated weight reaches u times the whole weight."""
    r = u * F.element_at(items, -1)["upto"]
    return F.get(F.filter(items, lambda x: x["upto"] >= r), F.lit(0))["item"]


def biased(items: DataFrame, matches: Column, weight: str, table: str, boost: bool = False) -> DataFrame:
    """Filtered: only matching rows of tables that have any. Boosted: matching rows weigh the table's whole weight more."""
    w = Window.partitionBy(table)
    if boost:
        return items.withColumn(weight, F.when(matches, F.col(weight) + F.sum(weight).over(w)).otherwise(F.col(weight)))
    return items.withColumn("_any", F.max(matches.cast("int")).over(w)).where((F.col("_any") == 0) | matches).drop("_any")
