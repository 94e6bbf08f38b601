"""Full-text queries from a table: terms, prefixes, phrases, NEAR groups, AND, OR, NOT and brackets over postings.

A query's text becomes a postfix array by one pass of a stack over its tokens, in column functions; its phrases, those of
all queries counted once, are joined to the postings; and each (query, document) that any of its leaves hits evaluates the
postfix array over the set of those leaves. NOT is binary, so that no query asks for documents that none of its leaves hits.

Grammar: word, word*, "some words", "some words"*, NEAR(word "some words", n) with n of 10 where it is left out; operators
in capitals, from the tightest: words side by side (and), NOT, AND, OR, each from left to right. A query that isn't well
formed, or has a leaf without letters or digits, matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.storage import materialise

_TOKEN = r'NEAR\([^()]*\)|"[^"]*"\*?|[()]|[^\s()"*]+\*?|\*'
_BESIDE = "&"
_RANK = {_BESIDE: 4, "NOT": 3, "AND": 2, "OR": 1}
#: Tables of the queries' terms, leaves and postfix arrays are broadcast up to this many rows.
BROADCAST_ROWS = 100_000
#: Parts that postings are dealt into, for each partition of a shuffle.
_DEALT = 8
#: Places of a phrase that one number's bits tell.
_BITS = 62
#: Tokens that NEAR allows between its first and last phrase, where it names no number.
NEAR = 10


def _rank(op: Column) -> Column:
    """How tightly an operator binds; a bracket less than any."""
    out = F.lit(0)
    for name, rank in _RANK.items():
        out = F.when(op == name, rank).otherwise(out)
    return out


def _popped(state: Column, least: Column | int) -> tuple[Column, Column]:
    """(output, operators) after the operators on top that bind at least so tightly have moved to the output."""
    ops = state["ops"]
    n = F.coalesce(F.array_position(F.transform(ops, lambda o: _rank(o) >= least), F.lit(False)), F.lit(0))
    n = F.when(n == 0, F.size(ops)).otherwise(n - 1).cast("int")
    return F.concat(state["out"], F.slice(ops, F.lit(1), n)), F.slice(ops, n + 1, F.greatest(F.size(ops), F.lit(1)))


def postfix(text: Column) -> Column:
    """The query's leaves and operators with operators after what they join; null if it isn't well formed."""
    strings = lambda *x: F.array(*x).cast("array<string>")

    def struct(out: Column, ops: Column, operand: Column | bool) -> Column:
        return F.struct(out.alias("out"), ops.alias("ops"), (F.lit(operand) if isinstance(operand, bool) else operand).alias("operand"))

    def step(s: Column, t: Column) -> Column:
        out, ops = _popped(s, 4)
        # side by side: the operator stands between without being written
        beside = F.when(s["operand"], struct(out, F.concat(strings(F.lit(_BESIDE)), ops), False)).otherwise(s)
        closed = _popped(s, 1)
        # a bracket that nothing opened stays, and is found below
        close = struct(closed[0], F.when(F.size(closed[1]) > 0, F.slice(closed[1], 2, 1 << 30)).otherwise(strings(F.lit(")"))), True)
        joined = _popped(s, _rank(t))
        return (
            F.when(t == "(", struct(beside["out"], F.concat(strings(F.lit("(")), beside["ops"]), False))
            .when(t == ")", close)
            .when(_rank(t) > 0, struct(joined[0], F.concat(strings(t), joined[1]), False))
            .otherwise(struct(F.array_append(beside["out"], t), beside["ops"], True))
        )

    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    start = struct(strings(), strings(), False)
    made = F.aggregate(tokens, start, step, lambda s: F.concat(s["out"], s["ops"]))
    depth = F.aggregate(made, F.lit(0), lambda n, t: F.when(n < 0, n).when(_rank(t) == 0, n + 1).when(n < 2, -1).otherwise(n - 1))
    return F.when((depth == 1) & ~F.exists(made, lambda t: t.isin("(", ")", "*")), made)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _leaves(queries: DataFrame, key: str) -> DataFrame:
    """(key, leaf, part, parts, within, words, open): each leaf's phrases; open ones end in a prefix."""
    leaf = queries.select(key, F.posexplode("postfix").alias("leaf", "t")).where(_rank(F.col("t")) == 0)
    near = F.col("t").rlike(r"^NEAR\(")
    inside = F.regexp_extract("t", r"^NEAR\((.*?)(,\s*\d+\s*)?\)$", 1)
    number = F.nullif(F.regexp_extract("t", r",\s*(\d+)\s*\)$", 1), F.lit("")).cast("int")
    phrases = F.when(near, F.regexp_extract_all(inside, F.lit(r'"[^"]*"\*?|[^\s"]+'), F.lit(0))).otherwise(F.array("t"))
    leaf = leaf.select(key, "leaf", F.coalesce(number, F.lit(NEAR)).alias("within"), phrases.alias("phrases"))
    parts = leaf.select(key, "leaf", "within", F.size("phrases").alias("parts"), F.posexplode("phrases").alias("part", "phrase"))
    return parts.select(key, "leaf", "part", "parts", "within", _words(F.col("phrase")).alias("words"), F.col("phrase").endswith("*").alias("open"))


def _few(df: DataFrame) -> DataFrame:
    """df, written already, as the side of a join that is broadcast if it has few rows, and merged else."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def _phrase_hits(phrases: DataFrame, index: DataFrame, doc: str) -> DataFrame:
    """(phrase, doc, start) where phrases (phrase, words, open, placed) stand; start is null for words that needn't be placed.

    Postings are met by the terms and prefixes that are asked for, whoever asks; those that are travel once, as numbers, to
    their document's task. What they mean to each phrase is worked out there.
    """
    asked = phrases.select("phrase", "open", "placed", F.size("words").alias("n"), F.posexplode("words").alias("k", "term")).withColumn("prefix", F.col("open") & (F.col("k") == F.col("n") - 1))
    asked = materialise(asked.select("phrase", "placed", "n", "k", "term", "prefix", F.xxhash64("term", "prefix").alias("key")))
    lengths = sorted(r[0] for r in asked.where("prefix").select(F.length("term")).distinct().collect())
    forms = [F.struct(F.col("term").alias("term"), F.lit(False).alias("prefix"))]
    forms += [F.struct(F.when(F.length("term") >= n, F.left("term", F.lit(n))).alias("term"), F.lit(True).alias("prefix")) for n in lengths]
    keys = materialise(asked.select("term", "prefix", "key").distinct())
    told = index.select(doc, "pos", F.explode(F.array(*forms)).alias("form")).select(doc, "pos", "form.*").join(_few(keys), ["term", "prefix"]).select(doc, "pos", "key")
    # many small parts: a part's phrases and starts are to fit into its task's memory
    deal = _DEALT * int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = told.repartition(deal, doc).join(_few(asked.drop("term", "prefix")), "key").withColumn("start", F.when(F.col("placed") | (F.col("n") > 1), F.col("pos") - F.col("k")))
    most = phrases.agg(F.max(F.size("words"))).first()[0] or 0
    parts = max(1, -(-most // _BITS))
    bit = F.expr(f"shiftleft(1L, k % {_BITS})")
    met = at.groupBy("phrase", "n", doc, "start").agg(*(F.bit_or(F.when(F.floor(F.col("k") / _BITS) == j, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"_m{j}") for j in range(parts)))
    return met.where(sum((F.bit_count(f"_m{j}") for j in range(parts)), F.lit(0)) == F.col("n")).select("phrase", doc, "start")


def matches(queries: DataFrame, index: DataFrame, key: str, doc: str, text: str = "query") -> DataFrame:
    """(key, doc) of the documents that each query matches. queries (key, text); index (term, doc, pos).

    Null queries match nothing; queries that repeat a key are one key's alternatives. Memory of a task follows one
    document's hits of one NEAR group, and the leaves of one query.
    """
    number = "_query"
    asked = materialise(queries.select(key, postfix(F.col(text)).alias("postfix")).where("postfix IS NOT NULL").distinct().withColumn(number, F.xxhash64(key, "postfix")))
    leaves = materialise(_leaves(asked, number))
    whole = leaves.groupBy(number).agg(F.min(F.size("words")).alias("least")).where("least > 0").select(number)
    leaves = materialise(leaves.join(whole, number, "left_semi").withColumn("phrase", F.xxhash64("words", "open")))
    phrases = leaves.groupBy("phrase").agg(F.first("words").alias("words"), F.first("open").alias("open"), F.bool_or(F.col("parts") > 1).alias("placed"))
    hits = materialise(_phrase_hits(materialise(phrases), index, doc))
    # hits are dealt out by document; what they mean to each query isn't
    plain = hits.select("phrase", doc).repartition(doc).distinct().join(_few(materialise(leaves.where("parts = 1").select("phrase", number, "leaf"))), "phrase").select(number, "leaf", doc)
    groups = materialise(leaves.where("parts > 1").select("phrase", number, "leaf", "parts", "within", "part", F.size("words").alias("size")))
    most = groups.agg(F.max("parts")).first()[0] or 0
    told = plain
    if most:
        near = hits.where("start IS NOT NULL").repartition(doc).join(_few(groups), "phrase").drop("phrase")
        upto = Window.partitionBy(number, "leaf", doc).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        # each phrase's last place up to here; the first of them is where the clump that ends here begins
        near = near.withColumns({f"last{k}": F.max(F.when(F.col("part") == k, F.struct("start", "size"))).over(upto) for k in range(most)})
        all_in, first = F.lit(True), F.lit(None).cast("struct<start:int,size:int>")
        for k in range(most):
            in_group = F.col("parts") > k
            all_in = all_in & (~in_group | F.col(f"last{k}").isNotNull())
            first = F.least(first, F.when(in_group, F.col(f"last{k}")))
        near = near.withColumn("first", first).where(all_in & (F.col("start") - F.col("first.start") - F.col("first.size") <= F.col("within")))
        told = plain.unionByName(near.select(number, "leaf", doc))
    hit = told.groupBy(number, doc).agg(F.collect_set("leaf").alias("hit")).join(_few(asked), number)
    numbered = F.transform("postfix", lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def evaluate(stack: Column, x: Column) -> Column:
        a, b = F.element_at(stack, -2), F.element_at(stack, -1)
        both = F.when(x["t"] == "OR", a | b).when(x["t"] == "NOT", a & ~b).otherwise(a & b)
        return F.when(_rank(x["t"]) == 0, F.array_append(stack, F.array_contains("hit", x["i"]))).otherwise(F.array_append(F.slice(stack, F.lit(1), F.size(stack) - 2), both))

    return hit.where(F.element_at(F.aggregate(numbered, F.array().cast("array<boolean>"), evaluate), -1)).select(key, doc).distinct()
