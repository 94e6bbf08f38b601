"""Chat relations over events (messages), customers (users) and nations (rooms): K rows, F16, F29, Z03."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import chat
from weft.sources.tables import load

#: The user that single-user queries look from.
ME = 7


class Chat:
    def __init__(self, spark: SparkSession, sf_dir: str):
        ev = load(spark, sf_dir, "events")
        self.users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("display_name"))
        self.rooms = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") % 2).alias("is_public"))
        self.messages = ev.select(F.col("event_id").alias("id"), (F.col("event_id") % 25).alias("room_id"), "user_id", F.col("event_type").alias("content"), F.col("ts").alias("created_at"))
        self.members = self.messages.where((F.col("user_id") + F.col("room_id")) % 3 != 0).groupBy("room_id", "user_id").agg(F.min("created_at").alias("last_read_at"))
        self.talk = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")


VIEWS = """WITH users AS (SELECT c_custkey AS id, c_name AS username, c_mktsegment AS display_name FROM customer),
rooms AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, (n_regionkey % 2)::INT AS is_public FROM nation),
messages AS (SELECT event_id AS id, event_id % 25 AS room_id, user_id, event_type AS content, ts AS created_at FROM events),
members AS (SELECT room_id, user_id, min(created_at) AS last_read_at FROM messages WHERE (user_id + room_id) % 3 <> 0 GROUP BY ALL),
talk AS (SELECT conv_id * 1000 + turn AS id, role, text FROM conversations),
terms AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term, unnest(range(0, len(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS pos FROM talk)
"""
#: Each room with the user's own mark, and one pass over the messages that counts what lies after it.
_OWN = f""", own AS (SELECT room_id, last_read_at FROM members WHERE user_id = {ME}),
seen AS (SELECT id, name, is_public, last_read_at, (room_id IS NOT NULL)::INT AS is_member FROM rooms LEFT JOIN own ON room_id = id),
tally AS (SELECT seen.id, count(messages.id) FILTER (is_member = 0 OR created_at > last_read_at) AS unread, max(created_at) AS last_message_at
  FROM seen LEFT JOIN messages ON room_id = seen.id GROUP BY seen.id)
"""
WORDS = ["the", "and"]


def _q(f):
    return lambda spark, sf_dir: f(Chat(spark, sf_dir))


def _index(c: Chat) -> DataFrame:
    return chat.tokens(c.talk, "id", "text")


def _new_members(c: Chat) -> DataFrame:
    return c.messages.select("room_id", "user_id", F.col("created_at").alias("last_read_at")).groupBy("room_id", "user_id").agg(F.max("last_read_at").alias("last_read_at"))


_CASES = {
    "k01": (lambda c: chat.lookup(c.users, id=ME).unionByName(chat.lookup(c.users, username="Customer#000000003")), f"SELECT * FROM users WHERE id = {ME} UNION ALL SELECT * FROM users WHERE username = 'Customer#000000003'"),
    "k02": (lambda c: c.users.select("id", "username").orderBy("username"), "SELECT id, username FROM users ORDER BY username"),
    "k03": (lambda c: chat.memberships(c.rooms, c.members, ME).select("id", "name", "last_read_at"), _OWN + "SELECT id, name, last_read_at FROM seen"),
    "k04": (lambda c: chat.unread_counts(c.rooms, c.members, c.messages, ME), _OWN + "SELECT id, unread FROM tally"),
    "k05": (lambda c: chat.last_messages(c.rooms, c.messages), _OWN + "SELECT id, last_message_at FROM tally"),
    "k06": (lambda c: chat.memberships(c.rooms, c.members, ME).select("id", "is_member"), _OWN + "SELECT id, is_member FROM seen"),
    "k07": (lambda c: c.rooms.join(chat.last_messages(c.rooms, c.messages), "id").orderBy(F.desc("is_public"), F.desc_nulls_last("last_message_at"), "id").select("id", "is_public"), "SELECT id, is_public FROM rooms"),
    "k08": (lambda c: chat.room_list(c.rooms, c.members, c.messages, ME), _OWN + "SELECT id, name, is_public, unread, last_message_at, is_member FROM seen JOIN tally USING (id)"),
    "k09": (lambda c: chat.history(c.messages, c.users, 3).select("id", "username", "content"), "SELECT m.id, username, content FROM messages m JOIN users u ON u.id = m.user_id WHERE room_id = 3 ORDER BY created_at, m.id LIMIT 50"),
    "k10": (lambda c: chat.search(c.messages.where(F.col("content") == "click").select("id"), c.messages, c.rooms, c.users, c.members, ME).select("id", "room_name", "username"), _OWN + "SELECT messages.id, seen.name AS room_name, username FROM messages JOIN seen ON seen.id = room_id AND is_member = 1 JOIN users ON users.id = user_id WHERE content = 'click' ORDER BY created_at DESC, messages.id DESC LIMIT 20"),
    "k11": (lambda c: chat.match_all(_index(c), "id", WORDS).withColumn("kind", F.lit("all")).unionByName(chat.match_phrase(_index(c), "id", ["and", "the"]).withColumn("kind", F.lit("phrase"))).unionByName(chat.match_prefix(_index(c), "id", "tion").withColumn("kind", F.lit("prefix"))).unionByName(chat.match_none(c.talk, _index(c), "id", WORDS).withColumn("kind", F.lit("none"))).unionByName(chat.match_any(_index(c), "id", WORDS).withColumn("kind", F.lit("any"))),
            "SELECT id, 'all' AS kind FROM terms WHERE term IN ('the', 'and') GROUP BY id HAVING count(DISTINCT term) = 2 UNION ALL SELECT DISTINCT a.id, 'phrase' FROM terms a JOIN terms b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'and' AND b.term = 'the' UNION ALL SELECT DISTINCT id, 'prefix' FROM terms WHERE term LIKE 'tion%' UNION ALL SELECT id, 'none' FROM talk WHERE id NOT IN (SELECT id FROM terms WHERE term IN ('the', 'and')) UNION ALL SELECT DISTINCT id, 'any' FROM terms WHERE term IN ('the', 'and')"),
    "k12": (lambda c: chat.recent_rooms(c.messages, c.rooms, ME).select("id", "name", "is_public"), f"SELECT id, name, is_public FROM rooms JOIN (SELECT room_id, max(created_at) AS last_used FROM messages WHERE user_id = {ME} GROUP BY room_id) ON room_id = id ORDER BY last_used DESC, id LIMIT 5"),
    "k13": (lambda c: c.users.join(c.messages.select(F.col("user_id").alias("id")), "id", "left_semi").select("id"), "SELECT id FROM users WHERE id IN (SELECT user_id FROM messages)"),
    "k14": (lambda c: chat.insert_absent(c.members, _new_members(c), ["room_id", "user_id"]), "SELECT * FROM members UNION ALL SELECT room_id, user_id, max(created_at) FROM messages m WHERE NOT EXISTS (SELECT 1 FROM members x WHERE x.room_id = m.room_id AND x.user_id = m.user_id) GROUP BY ALL"),
    "k15": (lambda c: c.messages.unionByName(c.messages.select((-F.col("id") - 1).alias("id"), "room_id", "user_id", "content", "created_at")).where(F.col("id") < 0).join(c.users.select(F.col("id").alias("user_id"), "username"), "user_id").select("id", "username", "content"), "SELECT -m.id - 1 AS id, username, content FROM messages m JOIN users u ON u.id = m.user_id"),
    "k16": (lambda c: chat.delete_matching(c.members, c.messages.where(F.col("content") == "click").select("room_id", "user_id"), ["room_id", "user_id"]), "SELECT * FROM members x WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE content = 'click' AND m.room_id = x.room_id AND m.user_id = x.user_id)"),
    "k17": (lambda c: chat.update_where(c.rooms, F.col("is_public") == 0, is_public=F.lit(1)), "SELECT id, name, 1 AS is_public, is_public = 0 AS changed FROM rooms"),
    "k18": (lambda c: c.messages.select("room_id", "content").distinct(), "SELECT DISTINCT room_id, content FROM messages"),
    "k19": (lambda c: chat.insert_absent(c.rooms.select("name"), c.messages.select(chat.dm_key(F.col("user_id"), F.col("room_id")).alias("name")), ["name"]), "SELECT name FROM rooms UNION SELECT '_dm_' || least(user_id, room_id) || '_' || greatest(user_id, room_id) FROM messages"),
    "f16": (lambda c: chat.accessible(c.rooms, c.members, ME), _OWN + "SELECT id, name, is_public FROM seen WHERE is_public = 1 OR is_member = 1"),
    "f29": (lambda c: c.messages.select("id", chat.dm_key(F.col("user_id"), F.col("room_id")).alias("name"), chat.dm_other(chat.dm_key(F.col("user_id"), F.col("room_id")), F.col("user_id")).alias("other")), "SELECT id, '_dm_' || least(user_id, room_id) || '_' || greatest(user_id, room_id) AS name, room_id AS other FROM messages"),
    "z03": (lambda c: chat.unread_by_member(c.members, c.messages), "SELECT a.room_id, a.user_id, count(b.id) AS unread FROM members a LEFT JOIN messages b ON b.room_id = a.room_id AND b.created_at > a.last_read_at GROUP BY ALL"),
}

QUERIES = {k: _q(f) for k, (f, _) in _CASES.items()}
SQL = {k: VIEWS + sql for k, (_, sql) in _CASES.items()}
