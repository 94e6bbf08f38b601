"""Near-duplicate documents by SimHash: 64-bit fingerprints, pigeonhole blocks, Hamming distance.

1. A document's fingerprint has a bit where more than half of its word shingles' XXH64 values have it (repeats count).
   Texts are hashed in stretches, so that a task's memory doesn't follow the longest text.
2. Documents with equal fingerprints are one node, named by the fingerprint; copies are never expanded.
3. A fingerprint is split into PARTS parts. Two of them that differ in at most BITS bits agree in at least PARTS - BITS
   parts, so that they share one of the blocks made of that many parts; nodes are joined on (which parts, their value).
4. Blocks of at most SMALL nodes give their pairs, verified by Hamming distance. A larger block would give the square of
   its size; its nodes are verified by balls instead: two fingerprints differ in at most two bits just when some value is
   within one bit of both, so that each node is sent to the 65 values around it and linked to the least node that is
   there too. A value has at most 65 nodes around it, whatever the data.
5. Components of the links name each document's smallest reachable doc_id.

Null and empty texts (and those without words) have fingerprint zero and are linked like any other. Rows that repeat a
doc_id each get a row of their own, linked by their own text. Rows with a null doc_id have a fingerprint, name no
component, and get that of their fingerprint (null if no document with an id is linked to it). Further columns take no
part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.components import spread_labels
from weft.llm.common import fresh_name, materialise, slices, table

SHINGLE_WORDS, SEED = 3, 42
BITS, PARTS = 2, 4
#: Blocks of more nodes than this are verified by balls.
SMALL = 64
#: Bytes of text that are hashed at a time, and values whose bits are counted at a time.
STRETCH, COUNTED = 1 << 20, 1 << 14

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = b" \t\n\x0b\x0c\r"


def _stretches(text: bytes, most: int = STRETCH) -> Iterator[bytes]:
    """The text in pieces of about `most` bytes, cut at blanks; a longer word stays whole."""
    at = 0
    while at < len(text):
        end = at + most
        while end < len(text) and text[end] not in _BLANK:
            end += 1
        yield text[at:end]
        at = end


def _bits(values: list[int]) -> np.ndarray:
    """How many of the values have each bit, from the lowest."""
    out = np.zeros(64, np.int64)
    for k in range(0, len(values), COUNTED):
        raw = np.array(values[k : k + COUNTED], dtype="<u8").view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: str | None, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text; zero if it has no words."""
    digest = xxhash.xxh64_intdigest
    ones, total, last = np.zeros(64, np.int64), 0, []
    for piece in _stretches((text or "").encode().translate(_LOWER)):
        words = last + piece.split()
        last = words[-(size - 1) :] if size > 1 else []
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1 if words else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(words) else ends
        values = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=False)]
        ones += _bits(values)
        total += len(values)
    if not total:
        if not last:
            return 0
        ones, total = _bits([digest(b" ".join(last), seed)]), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, name: str, size: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and `name`: each row's fingerprint as a (signed) long."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", name])

    return df.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {name} long")


def _part_masks(parts: int) -> list[int]:
    edges = [64 * k // parts for k in range(parts + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_fingerprints(nodes: DataFrame, parts: int = PARTS, small: int = SMALL) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column node) whose components are those of all pairs BITS bits apart or less.

    Every pair of a small block is a link; of large blocks a node is linked to the least node around each value.
    """
    masks = [_signed(sum(m)) for m in combinations(_part_masks(parts), parts - BITS)]
    shared = F.array(*(F.struct(F.lit(k).alias("parts"), F.col("node").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(masks)))
    blocks = nodes.select("node", F.explode(shared).alias("b")).select("node", "b.*")
    # written first, so that Spark can split a block of many nodes in the join
    sizes = materialise(blocks.groupBy("parts", "value").agg(F.count("*").alias("n")).where("n > 1"))
    held = materialise(blocks.join(sizes, ["parts", "value"]))
    left, right = held.where(F.col("n") <= small).drop("n").withColumnRenamed("node", "a"), held.where(F.col("n") <= small).drop("n").withColumnRenamed("node", "b")
    pairs = left.join(right, ["parts", "value"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << k)) for k in range(64)))
    crowded = held.where(F.col("n") > small).select("node").distinct()
    around = crowded.select("node", F.explode(flips).alias("flip")).select("node", F.col("node").bitwiseXOR(F.col("flip")).alias("value"))
    # at most 65 nodes a value
    stars = around.groupBy("value").agg(F.min("node").alias("a"), F.collect_list("node").alias("all")).where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a < b")
    return pairs.union(stars).distinct()


def near_documents(df: DataFrame, parts: int = PARTS, small: int = SMALL) -> DataFrame:
    """Per row: doc_id, fingerprint (hexadecimal) and component_id."""
    print_ = fresh_name(df, "print")
    docs = materialise(fingerprints(df, print_).withColumnRenamed(print_, "node"))
    nodes = materialise(docs.groupBy("node").agg(F.min("doc_id").alias("first")))
    labels = spread_labels(near_fingerprints(nodes.select("node"), parts, small))
    classes = nodes.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    least = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    # equal fingerprints of many documents are one hot key of the larger side, which Spark splits at run time
    named = materialise(classes.join(least, "label").select("node", "component_id"))
    return docs.join(named, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))
