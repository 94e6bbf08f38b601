"""Text operators over documents, pages, conversations and the dimension tables (F, T, R, D, S rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as X
from weft.operators import ranking
from weft.sources import files
from weft.sources.tables import load


def _posts(spark, d) -> DataFrame:
    """Orders as posts with front matter."""
    o = load(spark, d, "orders")
    return o.select("o_orderkey", F.concat(F.lit("---\nTitle: Order "), F.col("o_orderkey").cast("string"), F.lit("\ndate: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\ntags: ["), F.col("o_orderpriority"), F.lit(', "'), F.col("o_orderstatus"), F.lit('"]\n---\n\nBody **of** '), F.col("o_orderpriority"), F.lit(" \n")).alias("raw"))


_POST_SQL = """WITH posts AS (SELECT o_orderkey, '---' || chr(10) || 'Title: Order ' || o_orderkey || chr(10) || 'date: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'tags: [' || o_orderpriority || ', "' || o_orderstatus || '"]' || chr(10) || '---' || chr(10) || chr(10) || 'Body **of** ' || o_orderpriority || ' ' || chr(10) AS raw, * FROM orders) """
_FALSE_WORD = "[^a-z0-9]+"


def f01(spark, d):
    return _posts(spark, d).withColumn("m", X.front_matter("raw")).select("o_orderkey", F.col("m")["title"].alias("title"), F.col("m")["date"].alias("date"))


def f02(spark, d):
    return _posts(spark, d).withColumn("m", X.front_matter("raw")).select("o_orderkey", F.array_join(X.tag_list(F.col("m")["tags"]), "|").alias("tags"), X.typed_kind(F.col("m")["tags"]).alias("kind"), X.typed_kind(F.col("m")["date"]).alias("date_kind"))


def f03(spark, d):
    return _posts(spark, d).select("o_orderkey", F.regexp_replace(X.body("raw"), r"^\s+|\s+$", "").alias("body"))


def f04(spark, d):
    o = load(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", F.date_format(X.parse_date(text), "yyyyMMdd").alias("day"))


def f05(spark, d):
    return load(spark, d, "orders").select("o_orderkey", X.month_label(F.col("o_orderdate")).alias("label"), F.date_format("o_orderdate", "MMMM dd, yyyy").alias("full"))


def f07(spark, d):
    p = load(spark, d, "part")
    raw = F.concat(F.lit("![pic](/i/"), F.col("p_partkey").cast("string"), F.lit(".png) **"), F.col("p_brand"), F.lit("** `"), F.col("p_type"), F.lit("` ["), F.col("p_name"), F.lit("](/p) _"), F.col("p_brand"), F.lit("_ **"), F.col("p_size").cast("string"), F.lit("*2** *now* a__b"))
    return p.select("p_partkey", X.inline_markup(raw).alias("html"))


def f10(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("hi @user"), F.col("c_custkey").cast("string"), F.lit(" and @"), F.lower("c_mktsegment"), F.lit("!")).alias("t"))
    return c.select("c_custkey", X.link_mentions("t").alias("html"), F.array_join(X.mentions("t"), ",").alias("names"))


def f11(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(X.words("text")).alias("n_words"), F.size(X.bigrams("text")).alias("n_bigrams"))


def f23(spark, d):
    """First failing rule for each turn: empty, unknown role, repeat of the turn before."""
    c = load(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rule = F.when(F.trim("text") == "", "empty").when(~F.lower("role").isin("user", "assistant"), F.concat(F.lit("unknown_role:"), F.col("role"))).when(F.col("text") == F.lag("text").over(w), "repeat")
    return c.select("conv_id", "turn", rule.alias("rule"))


def f32(spark, d):
    msg = F.when(F.col("rule") == "empty", "The turn is empty.").when(F.startswith("rule", F.lit("unknown_role:")), F.concat(F.lit("Unknown: "), F.substring_index("rule", ":", -1))).when(F.col("rule") == "repeat", "Said before.").otherwise("Fine.")
    return f23(spark, d).select("conv_id", "turn", msg.alias("message"))


_F23 = "SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN lower(role) NOT IN ('user', 'assistant') THEN 'unknown_role:' || role WHEN text = lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) THEN 'repeat' END AS rule FROM conversations"


def r01(spark, d):
    """Tag scores of documents for the names of regions and the first words of all benchmark items."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    tags = spark.createDataFrame([], "tag string").unionByName(load(spark, d, "region").select(F.lower("r_name").alias("tag"))).unionByName(load(spark, d, "benchmark").select(F.element_at(X.words("text"), 1).alias("tag"))).where("tag is not null").distinct()
    return ranking.tag_scores(docs, tags, "doc_id")


def t01(spark, d):
    return ranking.top_by(r01(spark, d).where("score > 0"), ["score"], ["doc_id"], 3).select("doc_id", "score")


_TAGS = "tags AS (SELECT DISTINCT tag FROM (SELECT lower(r_name) AS tag FROM region UNION ALL SELECT regexp_extract(lower(text), '[a-z]+') FROM benchmark) WHERE tag <> '')"
_R01 = f"""WITH {_TAGS}, wl AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '[a-z]+') AS l FROM documents),
w AS (SELECT doc_id, t, list_distinct(l) AS ws, list_distinct(list_transform(list_zip(l[:-2], l[2:]), lambda p: p[1] || '_' || p[2])) AS two FROM wl),
tl AS (SELECT tag, regexp_extract_all(tag, '[a-z]+') AS l FROM tags), g AS (SELECT tag, list_transform(list_zip(l[:-2], l[2:]), lambda p: p[1] || '_' || p[2]) AS pairs FROM tl)
SELECT doc_id, sum(CASE WHEN list_contains(ws, tag) THEN 1.0 + least(0.5 * ((length(t) - length(replace(t, tag, ''))) // length(tag)), 2.0) ELSE 0.0 END
  + CASE WHEN len(pairs) > 0 THEN 2.0 * len(list_filter(pairs, lambda p: list_contains(two, p))) ELSE 0.0 END)::DOUBLE AS score FROM w, g GROUP BY doc_id"""


def r02(spark, d):
    tags = load(spark, d, "region").agg(F.sort_array(F.collect_list(F.lower("r_name"))).alias("tags"))
    docs = load(spark, d, "documents")
    return docs.join(F.broadcast(tags)).select("doc_id", F.size(F.filter("tags", lambda t: F.contains(F.lower("text"), t))).alias("n"))


def d10(spark, d):
    """Orders with the heading of their year at its newest one."""
    o = load(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", "o_orderdate")
    newest = o.groupBy(F.col("year").alias("_year")).agg(F.min_by("o_orderkey", F.struct(-F.unix_date(F.col("o_orderdate").cast("date")), "o_orderkey")).alias("first"))
    return o.join(newest, F.col("year").eqNullSafe(F.col("_year"))).select("o_orderkey", F.coalesce(F.col("year").cast("string"), F.lit("Unknown")).alias("year"), (F.col("o_orderkey") == F.col("first")).alias("header"))


def d11(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderdate", F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("tag"))
    count = o.groupBy("tag").agg(F.count("*").cast("int").alias("n"))
    newest = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")), asc=False)
    last = ranking.newest(o, ["tag"], ["o_orderdate", "o_orderkey"], 20).groupBy(F.col("tag").alias("_tag")).agg(newest.alias("l"))
    return count.join(last, F.col("tag").eqNullSafe(F.col("_tag"))).select("tag", "n", F.array_join(F.transform("l", lambda x: x["o_orderkey"].cast("string")), ",").alias("newest"))


def d13(spark, d):
    c = load(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return c.select("conv_id", "turn", F.lag("turn").over(w).alias("newer"), F.lead("turn").over(w).alias("older"))


def t02(spark, d):
    o = load(spark, d, "orders")
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    w = Window.partitionBy("o_custkey").orderBy("tier", F.desc("o_orderdate"), "o_orderkey")
    return o.withColumn("tier", tier).withColumn("place", F.row_number().over(w)).where("place <= 3").select("o_custkey", "o_orderkey", "tier", "place")


def s08(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    return files.edited(docs, "text", "The and", "THE AND").select("doc_id", "outcome", F.md5("text").alias("md5"))


_CASES = {
    "f01": (f01, _POST_SQL + "SELECT o_orderkey, 'Order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS date FROM posts"),
    "f02": (f02, "SELECT o_orderkey, o_orderpriority || '|' || o_orderstatus AS tags, 'list' AS kind, 'string' AS date_kind FROM orders"),
    "f03": (f03, _POST_SQL + "SELECT o_orderkey, trim(regexp_replace(raw, '^---\\n.*?---', '', 's'), E' \\n') AS body FROM posts"),
    "f04": (f04, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m01') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y%m%d') END AS day FROM orders"),
    "f05": (f05, "SELECT o_orderkey, strftime(o_orderdate, '%B %Y') AS label, strftime(o_orderdate, '%B %d, %Y') AS full FROM orders"),
    "f06": (lambda s, d: load(s, d, "part").select("p_partkey", X.slugify(F.concat("p_name", F.lit(" & "), "p_type", F.lit("!"))).alias("slug")), "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part"),
    "f07": (f07, "SELECT p_partkey, '<img src=\"/i/' || p_partkey || '.png\" alt=\"pic\"> <strong>' || p_brand || '</strong> <code>' || p_type || '</code> <a href=\"/p\">' || p_name || '</a> <em>' || p_brand || '</em> <strong>' || p_size || '*2</strong> <em>now</em> a__b' AS html FROM part"),
    "f09": (lambda s, d: load(s, d, "pages").select("page_id", F.md5(X.escape_html("html")).alias("md5"), F.md5(X.escape_html("html", "&<")).alias("md5_short")), "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')) AS md5, md5(replace(replace(html, '&', '&amp;'), '<', '&lt;')) AS md5_short FROM pages"),
    "f10": (f10, "SELECT c_custkey, 'hi <a href=\"/users/user' || c_custkey || '\">@user' || c_custkey || '</a> and <a href=\"/users/' || lower(c_mktsegment) || '\">@' || lower(c_mktsegment) || '</a>!' AS html, 'user' || c_custkey || ',' || lower(c_mktsegment) AS names FROM customer"),
    "f11": (f11, "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) SELECT doc_id, len(list_distinct(w))::INT AS n_words, len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])))::INT AS n_bigrams FROM w"),
    "f12": (lambda s, d: load(s, d, "documents").select("doc_id", F.size(X.split_words("text")).alias("n")), "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INT AS n FROM documents"),
    "f13": (lambda s, d: load(s, d, "part").select("p_partkey", F.array_join(X.characters("p_name"), "|").alias("chars")), "SELECT p_partkey, array_to_string(string_split(p_name, ''), '|') AS chars FROM part"),
    "f15": (lambda s, d: load(s, d, "documents").select("doc_id", X.measure("text").alias("m")).select("doc_id", "m.width", "m.height"), "SELECT doc_id, (length(text) * 8)::INT AS width, (len(string_split(text, chr(10))) * 16)::INT AS height FROM documents"),
    "f17": (lambda s, d: load(s, d, "part").select("p_partkey", F.col("p_brand").rlike("^[a-zA-Z0-9_]+$").alias("name_ok"), F.col("p_name").rlike("^[a-zA-Z0-9 -]+$").alias("room_ok")), "SELECT p_partkey, regexp_full_match(p_brand, '[a-zA-Z0-9_]+') AS name_ok, regexp_full_match(p_name, '[a-zA-Z0-9 -]+') AS room_ok FROM part"),
    "f18": (lambda s, d: load(s, d, "part").select("p_partkey", X.allowed_prefix("p_type", ["STANDARD", "SMALL", "PROMO"]).alias("ok")), "SELECT p_partkey, starts_with(p_type, 'STANDARD') OR starts_with(p_type, 'SMALL') OR starts_with(p_type, 'PROMO') AS ok FROM part"),
    "f19": (lambda s, d: load(s, d, "documents").select("doc_id", X.ellipsis("text", 40).alias("short")), "SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS short FROM documents"),
    "f20": (lambda s, d: load(s, d, "documents").select("doc_id", F.md5(X.first_lines("text", 3)).alias("md5")), "SELECT doc_id, md5(CASE WHEN len(l) > 3 THEN array_to_string(l[1:3], chr(10)) || chr(10) || '... (' || (len(l) - 3) || ' more lines)' ELSE text END) AS md5 FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)"),
    "f21": (lambda s, d: load(s, d, "orders").select("o_orderkey", X.age_label(F.col("o_orderkey") * 97).alias("age")), "SELECT o_orderkey, CASE WHEN o_orderkey * 97 < 3600 THEN (o_orderkey * 97 // 60) || 'm' WHEN o_orderkey * 97 < 86400 THEN (o_orderkey * 97 // 3600) || 'h' ELSE (o_orderkey * 97 // 86400) || 'd' END AS age FROM orders"),
    "f23": (f23, _F23),
    "f25": (lambda s, d: load(s, d, "nation").select("n_nationkey", X.join_url(F.lit("https://x.example/"), F.concat(F.lit("/"), F.lower("n_name"))).alias("url")), "SELECT n_nationkey, 'https://x.example/' || lower(n_name) AS url FROM nation"),
    "f27": (lambda s, d: load(s, d, "part").select("p_partkey", X.seed_hash("p_name").alias("seed")), "SELECT p_partkey, ('0x' || right(sha256(p_name), 8))::BIGINT AS seed FROM part"),
    "f28": (lambda s, d: load(s, d, "part").select("p_partkey", X.rolling_hash("p_name").alias("h")), "SELECT p_partkey, list_reduce(list_concat([0::BIGINT], list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM part"),
    "f30": (lambda s, d: load(s, d, "customer").select("c_custkey", X.display_name(F.when(F.col("c_custkey") % 2 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment")), F.col("c_name")).alias("shown"), X.initials(F.col("c_name")).alias("initials")), "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS shown, upper(left(c_name, 2)) AS initials FROM customer"),
    "f31": (lambda s, d: load(s, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(X.card(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("")).otherwise(F.lower("n_name"))))).alias("c")).select("n_regionkey", F.array_join("c", "\n\n").alias("cards")), "SELECT n_regionkey, string_agg(c, chr(10) || chr(10) ORDER BY c) AS cards FROM (SELECT n_regionkey, '## ' || n_name || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN '(empty)' ELSE lower(n_name) END AS c FROM nation) GROUP BY 1"),
    "f32": (f32, f"SELECT conv_id, turn, CASE WHEN rule = 'empty' THEN 'The turn is empty.' WHEN rule LIKE 'unknown_role:%' THEN 'Unknown: ' || split_part(rule, ':', -1) WHEN rule = 'repeat' THEN 'Said before.' ELSE 'Fine.' END AS message FROM ({_F23})"),
    "f34": (lambda s, d: load(s, d, "part").select("p_partkey", X.join_nonblank(F.array("p_brand", F.when(F.col("p_size") > 20, F.lit(" ")).otherwise(F.col("p_type")), "p_name")).alias("joined")), "SELECT p_partkey, p_brand || ', ' || CASE WHEN p_size > 20 THEN '' ELSE p_type || ', ' END || p_name AS joined FROM part"),
    "d10": (d10, "SELECT o_orderkey, coalesce(year(o_orderdate)::VARCHAR, 'Unknown') AS year, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey) = 1 AS header FROM orders"),
    "d11": (d11, "WITH t AS (SELECT o_orderkey, o_orderdate, unnest([o_orderpriority, o_orderstatus]) AS tag FROM orders), l AS (SELECT tag, list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS l FROM t GROUP BY tag) SELECT tag, len(l)::INT AS n, array_to_string(l[1:20], ',') AS newest FROM l"),
    "d13": (d13, "SELECT conv_id, turn, lag(turn) OVER w AS newer, lead(turn) OVER w AS older FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC, role, text)"),
    "r01": (r01, _R01),
    "r02": (r02, "SELECT doc_id, (SELECT count(*) FROM region WHERE contains(lower(text), lower(r_name)))::INT AS n FROM documents"),
    "t01": (t01, f"SELECT doc_id, score FROM ({_R01}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 3"),
    "t02": (t02, "SELECT * FROM (SELECT o_custkey, o_orderkey, tier, row_number() OVER (PARTITION BY o_custkey ORDER BY tier, o_orderdate DESC, o_orderkey) AS place FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END AS tier FROM orders)) WHERE place <= 3"),
    "t03": (lambda s, d: ranking.top_by(load(s, d, "orders"), ["o_orderdate"], ["o_orderkey"], 10).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 10"),
    "t04": (lambda s, d: ranking.newest(load(s, d, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id"), "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5"),
    "t05": (lambda s, d: files.grep(load(s, d, "documents").select("doc_id", "text"), "doc_id", "text", "[0-9]{4}").orderBy("doc_id", "line_no").limit(200).select("doc_id", "line_no"), "SELECT doc_id, k::INT AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(k) WHERE regexp_matches(l[k], '[0-9]{4}') ORDER BY doc_id, k LIMIT 200"),
    "t07": (lambda s, d: load(s, d, "orders").select("o_custkey").intersect(load(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"))).union(load(s, d, "customer").select("c_custkey").exceptAll(load(s, d, "orders").select("o_custkey").distinct()).select(-F.col("c_custkey"))), "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) UNION ALL SELECT -c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "t08": (lambda s, d: ranking.first_of(load(s, d, "documents"), ["text"], ["doc_id"]).select("doc_id"), "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"),
    "s01": (lambda s, d: files.lines(load(s, d, "documents").select("doc_id", "text"), "doc_id", "text").where(F.col("line_no").between(2, 4)).select("doc_id", "line_no", F.md5("line").alias("md5")), "SELECT doc_id, k::INT AS line_no, md5(l[k]) AS md5 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(2, 5)) AS u(k) WHERE k <= len(l)"),
    "s02": (lambda s, d: files.grep(load(s, d, "documents").select("doc_id", "text"), "doc_id", "text", "idiot|@").select("doc_id", "line_no"), "SELECT doc_id, k::INT AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(k) WHERE regexp_matches(l[k], 'idiot|@')"),
    "s06": (lambda s, d: files.not_ignored(load(s, d, "pages").select("page_id", F.regexp_extract("url", r"://([^?#]*)", 1).alias("path")), "path", ["en", "de"]).select("page_id"), "SELECT page_id FROM pages WHERE NOT list_has_any(string_split(regexp_extract(url, '://([^?#]*)', 1), '/'), ['en', 'de'])"),
    "s08": (s08, "SELECT doc_id, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'edited' ELSE 'ambiguous' END AS outcome, md5(CASE WHEN n = 1 THEN replace(text, 'The and', 'THE AND') ELSE text END) AS md5 FROM (SELECT *, (length(text) - length(replace(text, 'The and', ''))) // 7 AS n FROM documents)"),
    "s13": (lambda s, d: ranking.newest(ranking.newest(load(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], 1), ["user_id"], ["ts", "event_id"], 10).select("user_id", "event_type", "event_id"), "SELECT user_id, event_type, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10"),
    "s15": (lambda s, d: _posts(s, d).withColumn("m", X.front_matter("raw")).groupBy(F.col("m")["date"].isNotNull().alias("is_post")).count(), "SELECT true AS is_post, count(*) AS count FROM orders"),
    "s18": (lambda s, d: load(s, d, "events").select("event_id", F.from_json("props", "k string").alias("p")).select("event_id", F.col("p.k").alias("k")), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "s29": (lambda s, d: load(s, d, "pages").select("page_id", F.array_join(F.map_keys(X.query_map("url")), ",").alias("keys")), "SELECT page_id, CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) <> '' THEN array_to_string(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1)), ',') END AS keys FROM pages"),
}

QUERIES = {k: f for k, (f, _) in _CASES.items()}
SQL = {k: sql for k, (_, sql) in _CASES.items()}
