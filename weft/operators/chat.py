"""Relational operators over users, rooms, room_members and messages.

users (id, username, display_name); rooms (id, name, is_public); members (room_id, user_id, last_read_at);
messages (id, room_id, user_id, content, created_at).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the given values."""
    return df.where(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in keys.items())))


def memberships(rooms: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """All rooms with the user's last_read_at, null where they are no member (the user filter comes before the outer join)."""
    own = members.where(F.col("user_id") == user_id).select(F.col("room_id").alias("id"), "last_read_at", F.lit(1).alias("is_member"))
    return rooms.join(own, "id", "left").withColumn("is_member", F.coalesce("is_member", F.lit(0)))


def unread_counts(rooms: DataFrame, members: DataFrame, messages: DataFrame, user_id: int) -> DataFrame:
    """room id and unread: messages after the user's last_read_at, all of them where they are no member."""
    own = memberships(rooms, members, user_id).select(F.col("id").alias("room_id"), "last_read_at", "is_member")
    newer = (F.col("is_member") == 0) | (F.col("created_at") > F.col("last_read_at"))
    counted = messages.join(own, "room_id").groupBy("room_id").agg(F.count_if(newer).alias("unread"))
    return own.join(counted, "room_id", "left").select(F.col("room_id").alias("id"), F.coalesce("unread", F.lit(0)).alias("unread"))


def last_messages(rooms: DataFrame, messages: DataFrame) -> DataFrame:
    newest = messages.groupBy(F.col("room_id").alias("id")).agg(F.max("created_at").alias("last_message_at"))
    return rooms.select("id").join(newest, "id", "left")


def room_list(rooms: DataFrame, members: DataFrame, messages: DataFrame, user_id: int) -> DataFrame:
    """Every room with unread, last message and membership; public and recent rooms first."""
    return (
        memberships(rooms, members, user_id).drop("last_read_at").join(unread_counts(rooms, members, messages, user_id), "id").join(last_messages(rooms, messages), "id")
        .orderBy(F.desc("is_public"), F.desc_nulls_last("last_message_at"), "id")
    )


def history(messages: DataFrame, users: DataFrame, room_id: int, n: int = 50) -> DataFrame:
    """The room's oldest n messages with their authors."""
    return messages.where(F.col("room_id") == room_id).join(users.select(F.col("id").alias("user_id"), "username", "display_name"), "user_id").orderBy("created_at", "id").limit(n)


def accessible(rooms: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """Rooms that are public or have the user as a member."""
    own = members.where(F.col("user_id") == user_id).select(F.col("room_id").alias("id"))
    return rooms.where(F.col("is_public") == 1).unionByName(rooms.where(F.col("is_public") != 1).join(own, "id", "left_semi"))


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, pos) of lower-case words of letters and digits."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))).alias("pos", "term"))


def match_all(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Keys that hold every term."""
    hits = index.where(F.col("term").isin(terms)).groupBy(key).agg(F.count_distinct("term").alias("n"))
    return hits.where(F.col("n") == len(set(terms))).select(key)


def match_any(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    return index.where(F.col("term").isin(terms)).select(key).distinct()


def match_none(df: DataFrame, index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    return df.select(key).join(match_any(index, key, terms), key, "left_anti")


def match_prefix(index: DataFrame, key: str, prefix: str) -> DataFrame:
    return index.where(F.col("term").startswith(prefix)).select(key).distinct()


def match_phrase(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Keys that hold the terms one after another: places shifted to the phrase's start are counted, without a self-join."""
    place = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for k, t in enumerate(terms)))
    starts = index.where(F.col("term").isin(terms)).select(key, "pos", F.explode(F.filter(place, lambda p: p["t"] == F.col("term"))).alias("p"))
    at = starts.select(key, (F.col("pos") - F.col("p.k")).alias("start"), F.col("p.k").alias("k"))
    return at.groupBy(key, "start").agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(terms)).select(key).distinct()


def search(hits: DataFrame, messages: DataFrame, rooms: DataFrame, users: DataFrame, members: DataFrame, user_id: int, n: int = 20) -> DataFrame:
    """Messages among hits (id) in rooms of the user, newest first."""
    own = members.where(F.col("user_id") == user_id).select("room_id")
    return (
        messages.join(hits, "id", "left_semi").join(own, "room_id", "left_semi")
        .join(rooms.select(F.col("id").alias("room_id"), F.col("name").alias("room_name")), "room_id")
        .join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
        .orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    )


def recent_rooms(messages: DataFrame, rooms: DataFrame, user_id: int, n: int = 5) -> DataFrame:
    """The rooms in which the user wrote last, newest first."""
    last = messages.where(F.col("user_id") == user_id).groupBy(F.col("room_id").alias("id")).agg(F.max("created_at").alias("last_used"))
    return rooms.join(last, "id").orderBy(F.desc("last_used"), "id").limit(n)


def insert_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base and those rows of new (one for each key) whose key base lacks."""
    return base.unionByName(new.dropDuplicates(keys).join(base, keys, "left_anti").select(*base.columns))


def delete_matching(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone, keys, "left_anti")


def update_where(base: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """base with columns replaced where the condition holds, and whether it did."""
    old = {k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()}
    return base.withColumns(old | {"changed": F.coalesce(condition, F.lit(False))})


def dm_key(a: Column, b: Column) -> Column:
    """The name of two users' private room."""
    return F.concat(F.lit("_dm_"), F.least(a, b).cast("string"), F.lit("_"), F.greatest(a, b).cast("string"))


def dm_other(name: Column, me: Column) -> Column:
    x, y = F.split_part(name, F.lit("_"), F.lit(3)).cast("bigint"), F.split_part(name, F.lit("_"), F.lit(4)).cast("bigint")
    return F.when(x == me, y).otherwise(x)


def unread_by_member(members: DataFrame, messages: DataFrame) -> DataFrame:
    """Unread messages of all members at once: reading marks and message counts of a room are merged by time and summed
    from the end, so that no message is paired with every member of its room. Days are summed first, so that a task
    orders a room's day, not a room."""
    marks = members.select("room_id", F.col("last_read_at").alias("t"), F.col("user_id").alias("reader"), F.lit(0).alias("n"))
    rows = messages.groupBy("room_id", F.col("created_at").alias("t")).agg(F.count("*").cast("int").alias("n")).withColumn("reader", F.lit(None).cast("bigint"))
    merged = marks.unionByName(rows).withColumn("day", F.to_date("t"))
    following = Window.partitionBy("room_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("room_id", F.to_date("t").alias("day")).agg(F.sum("n").alias("n")).unionByName(marks.select("room_id", F.to_date("t").alias("day"), F.lit(0).cast("bigint").alias("n")).distinct())
    later = days.groupBy("room_id", "day").agg(F.sum("n").alias("n")).select("room_id", "day", F.coalesce(F.sum("n").over(following), F.lit(0)).alias("later"))
    after = Window.partitionBy("room_id", "day").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("room_id", "t")
    counted = merged.withColumn("unread", F.sum("n").over(after) - F.sum("n").over(same)).where(F.col("reader").isNotNull())
    return counted.join(later, ["room_id", "day"]).select("room_id", F.col("reader").alias("user_id"), (F.col("unread") + F.col("later")).alias("unread"))
