"""Spelling variants grouped by PartEnum signatures over letter multisets.

A word is a set of (segment, letter, count so far): the letters of each third of the word, as multisets. One edit
changes at most two elements of that set, which is a binary vector with Hamming distance at most two:

* a replaced letter takes one element away and puts one in (words of equal length, distance two);
* an inserted letter puts one in (lengths differ by one, distance one). The longer word's segments are cut where the
  shorter's are, once for each segment that may hold the letter more.

Elements fall into parts by hash, and a signature is what a word has in all parts but some: all choices of two parts
out of PARTS are left out for equal lengths, one part out of PARTS_ONE for unequal ones. Differing elements fill no more
parts than were left out, so near words share a signature (its 64-bit hash). Words are equi-joined on signatures and
verified by edit distance; colliding hashes only add candidates.

A signature of more than SMALL words would give the square of its size. Its words are verified by equality instead:
each is written with one place open (equal lengths) or one place removed (the longer one), and joined on the signature
and that writing, where only words that are near meet.

Null texts have no words, a null doc_id counts as the empty string in the checksum, rows that repeat a doc_id each count,
further columns take no part, and an empty table gives no rows. Repeats and ties: `n` counts occurrences; of near words
of equal n the smallest in code-point order is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import as_long, materialise, slices, table

RUN = r"[A-Za-zÀ-ÿ]+"
DELETE_ONE_IN = 31
LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
SEGMENTS, PARTS, PARTS_ONE = 3, 6, 4
#: Signatures of more words than this are verified by open places.
SMALL = 64


def lowered(text: Column) -> Column:
    """A to Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted_words(df: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters after the deletions, counted over all texts."""
    runs = df.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(lowered(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DELETE_ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _elements(word: str, cuts: list[int]) -> list[tuple[int, str, int]]:
    """(segment, letter, how many of that letter came before in the segment), for segments that end at the cuts."""
    out, seen, segment = [], Counter(), 0
    for k, c in enumerate(word):
        while segment < len(cuts) and k >= cuts[segment]:
            segment += 1
        out.append((segment, c, seen[segment, c]))
        seen[segment, c] += 1
    return out


def _parts(elements: list[tuple[int, str, int]], parts: int) -> list[str]:
    """What falls into each part, written the same for the same elements."""
    held: list[list[str]] = [[] for _ in range(parts)]
    for s, c, k in elements:
        e = f"{s}{c}{k} "
        held[xxhash.xxh32_intdigest(e, 1) % parts].append(e)
    return ["".join(sorted(x)) for x in held]


def _signed(kind: str, length: int, held: list[str], out: int) -> list[int]:
    """Hashes of the parts less every choice of `out` of them."""
    return [xxhash.xxh3_64_intdigest(f"{kind}{length}|{gone}|" + "|".join(x for k, x in enumerate(held) if k not in gone)) for gone in combinations(range(len(held)), out)]


def _cuts(length: int, segments: int) -> list[int]:
    return [length * k // segments for k in range(1, segments)]


def signatures(word: str, segments: int = SEGMENTS, parts: int = PARTS, parts_one: int = PARTS_ONE) -> dict[str, list[int]]:
    """Signatures by role: equal (for words of the same length), short and long (for one letter more or less)."""
    n = len(word)
    own, shorter = _cuts(n, segments), _cuts(n - 1, segments)
    plain = _elements(word, own)
    longer: set[int] = set()
    for s in range(segments):
        longer.update(_signed("one", n - 1, _parts(_elements(word, [c + (k >= s) for k, c in enumerate(shorter)]), parts_one), 1))
    return {"equal": _signed("two", n, _parts(plain, parts), 2), "short": _signed("one", n, _parts(plain, parts_one), 1), "long": sorted(longer)}


_ROLES = ("equal", "short", "long")


def _signed_words(words: DataFrame) -> DataFrame:
    """(signature, role, word, n)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2_000):
            sigs, roles, at = [], [], []
            for k, w in enumerate(batch.column(0).to_pylist()):
                for role, got in enumerate(signatures(w).values()):
                    sigs += got
                    roles += [role] * len(got)
                    at += [k] * len(got)
            rows = pa.array(at, pa.int64())
            cols = [as_long(np.array(sigs, np.uint64)), pa.array(roles, pa.int8()), batch.column(0).take(rows), batch.column(1).take(rows)]
            yield pa.RecordBatch.from_arrays(cols, names=["signature", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(work, "signature long, role byte, word string, n long")


def near_words(words: DataFrame, small: int = SMALL) -> DataFrame:
    """(word, n, other, other_n) of all words one edit apart, both ways round."""
    signed = materialise(_signed_words(words))
    # pairs of equal lengths need two words, others one of each role; written first, so that Spark can split a large signature
    sizes = materialise(signed.groupBy("signature").agg(F.count("*").alias("size")).where("size > 1"))
    held = materialise(signed.join(sizes, "signature"))
    few, many = held.where(F.col("size") <= small), held.where(F.col("size") > small)

    def meet(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        return a.join(b.select(*on, F.col("word").alias("other"), F.col("n").alias("other_n")), on).select("word", "n", "other", "other_n")

    equal, short, long_ = (few.where(F.col("role") == k) for k in range(3))
    near = (F.levenshtein("word", "other", 1) == 1)
    found = meet(equal, equal, ["signature"]).where(F.col("word") < F.col("other")).where(near).union(meet(short, long_, ["signature"]).where(near))

    places = F.sequence(F.lit(1), F.length("word"))
    rest = F.concat(F.expr("substring(word, 1, place - 1)"), F.expr("substring(word, place + 1)"))
    opened = many.where("role = 0").withColumn("place", F.explode(places)).withColumn("rest", rest)
    removed = many.where("role = 2").withColumn("place", F.explode(places)).withColumn("rest", rest)
    found = found.union(meet(opened, opened, ["signature", "place", "rest"]).where(F.col("word") < F.col("other")))
    found = found.union(meet(many.where("role = 1").withColumn("rest", F.col("word")), removed, ["signature", "rest"]))
    found = materialise(found.distinct())
    return found.union(found.select("other", "other_n", "word", "n"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): forms followed to the last. Each round doubles the steps taken."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = nxt.select("word", "root")
        if not nxt.where("moved").limit(1).count():
            return now


def spelling_variants(df: DataFrame, ratio: int = RATIO, small: int = SMALL) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the texts."""
    words = materialise(counted_words(df))
    best = near_words(words, small).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left").withColumn("form_n", -F.col("best.minus"))
    fits = F.col("form_n") >= ratio * F.col("n")
    named = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    roots = follow(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE
polynomial AS (SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t FROM range(256) AS r(b)),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT d, run, count(*) AS k, hex(encode(d || ':' || run)) AS bytes FROM runs GROUP BY d, run),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(bytes), 2), lambda i: ('0x' || substr(bytes, i, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) % 256) + 1], c // 256))) AS h FROM counted, polynomial),
words AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gaps AS a JOIN gaps AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, w.n, g.word, g.n FROM gaps AS g JOIN words AS w ON g.rest = w.word
  UNION SELECT g.word, g.n, w.word, w.n FROM gaps AS g JOIN words AS w ON g.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min({'minus': -other_n, 'form': other}) AS b FROM pairs GROUP BY word),
named AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.minus >= 10 * w.n THEN b.form END AS form, CASE WHEN -b.minus >= 10 * w.n THEN -b.minus END AS form_n
  FROM words AS w LEFT JOIN best ON w.word = best.word),
up AS (
  SELECT word, word AS root, form AS next FROM named
  UNION ALL SELECT up.word, named.word, named.form FROM up JOIN named ON up.next = named.word)
SELECT named.word, named.form, up.root, named.n, named.n_near, named.form_n FROM named JOIN up ON named.word = up.word AND up.next IS NULL
"""
