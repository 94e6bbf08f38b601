"""Full-text queries made of benchmark items, over all documents (K11's grammar)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import chat, search
from weft.sources.tables import load

#: One form of query for items of each remainder by five; their words of four letters or more are w1 to w5.
_FORMS = 5


def _queries(spark, d) -> DataFrame:
    long = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 4)
    w = lambda k: F.get("w", F.lit(k - 1))
    forms = [
        F.concat(w(1), F.lit(" AND ("), w(2), F.lit(" OR "), F.left(w(3), F.lit(4)), F.lit("*) NOT "), w(4)),
        F.concat(F.lit('"'), w(1), F.lit(" "), w(2), F.lit('" OR '), w(3), F.lit(" "), w(4)),
        F.concat(F.lit("NEAR("), w(1), F.lit(" "), w(3), F.lit(", 3)")),
        F.concat(F.lit("("), w(1), F.lit(" OR "), w(2), F.lit(') AND "'), w(3), F.lit(" "), F.left(w(4), F.lit(2)), F.lit('"*')),
        F.concat(w(1), F.lit(" "), w(2), F.lit(" NOT "), w(3), F.lit(" OR "), w(5)),
    ]
    form = F.coalesce(*(F.when(F.pmod(F.col("n"), F.lit(_FORMS)) == k, q) for k, q in enumerate(forms)))
    items = load(spark, d, "benchmark").select("item_id", long.alias("w"), F.length("text").alias("n"))
    return items.select("item_id", form.alias("query"))


def k11_grammar(spark, d):
    index = chat.tokens(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return search.matches(_queries(spark, d), index, "item_id", "doc_id")


_SQL = """WITH post AS MATERIALIZED (SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS l FROM documents)),
item AS (SELECT item_id, length(text) % 5 AS form, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4) AS w FROM benchmark),
has AS MATERIALIZED (SELECT DISTINCT item_id, form, k, doc_id FROM item, range(1, 6) r(k) JOIN post ON term = w[k]),
two AS MATERIALIZED (SELECT DISTINCT item_id, form, k, a.doc_id FROM item, range(1, 4) r(k) JOIN post a ON a.term = w[k] JOIN post b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND (b.term = w[k + 1] OR (form = 3 AND k = 3 AND starts_with(b.term, w[4][:2]))) WHERE (form = 1 AND k = 1) OR (form = 3 AND k = 3)),
vocabulary AS (SELECT DISTINCT term FROM post),
begun AS (SELECT DISTINCT item_id, doc_id FROM item JOIN vocabulary v ON starts_with(v.term, w[3][:4]) JOIN post p ON p.term = v.term WHERE form = 0 AND w[3] IS NOT NULL),
near AS (SELECT DISTINCT item_id, a.doc_id FROM item JOIN post a ON a.term = w[1] JOIN post b ON b.term = w[3] AND b.doc_id = a.doc_id WHERE form = 2 AND abs(a.pos - b.pos) - 1 <= 3),
seen AS (SELECT item_id, form, doc_id, bool_or(k = 1) AS h1, bool_or(k = 2) AS h2, bool_or(k = 3) AS h3, bool_or(k = 4) AS h4, bool_or(k = 5) AS h5 FROM has GROUP BY ALL)
SELECT item_id, doc_id FROM seen LEFT JOIN begun USING (item_id, doc_id) WHERE form = 0 AND h1 AND (h2 OR begun.doc_id IS NOT NULL) AND NOT h4 AND len((SELECT w FROM item i WHERE i.item_id = seen.item_id)) >= 4
UNION SELECT item_id, doc_id FROM seen LEFT JOIN two USING (item_id, doc_id) WHERE seen.form = 1 AND (two.doc_id IS NOT NULL OR (h3 AND h4)) AND len((SELECT w FROM item i WHERE i.item_id = seen.item_id)) >= 4
UNION SELECT item_id, doc_id FROM near
UNION SELECT item_id, doc_id FROM seen JOIN two USING (item_id, doc_id) WHERE seen.form = 3 AND (h1 OR h2) AND len((SELECT w FROM item i WHERE i.item_id = seen.item_id)) >= 4
UNION SELECT item_id, doc_id FROM seen WHERE form = 4 AND ((h1 AND h2 AND NOT h3) OR h5) AND len((SELECT w FROM item i WHERE i.item_id = seen.item_id)) >= 5"""

QUERIES = {"k11_grammar": k11_grammar}
SQL = {"k11_grammar": _SQL}
