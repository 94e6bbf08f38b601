"""Line deduplication by a sharded minimal perfect hash over the hashes of lines that documents share.

1. Every document gives the distinct 128-bit hashes of its long line keys; they are counted by Spark (documents by
   key, and the largest doc_id), combined before the shuffle, so that a line of a third of all documents is no hot key.
2. Keys of enough documents are dealt into shards by hash, and a task for each shard builds a minimal perfect hash by
   hash-and-displace: keys fall into small buckets, and each bucket, largest first, gets a displacement that puts its
   keys on free slots. The slots index arrays of fingerprints (64 bits), counts and largest doc_ids.
3. Documents probe the arrays with their line hashes and drop what is found, save in the key's largest document.

The arrays are broadcast while there are at most BROADCAST_KEYS keys (28 bytes each, proven by a count). Beyond that
the probes travel to the shards instead, salted so that no group of probes is large, and the answers return by document.

Null or empty texts are one empty line; an empty table gives no rows. Rows with a null doc_id keep all lines and don't
count as documents. Repeated rows of a doc_id are one document, and each gets its row. Further columns are kept, whatever
their names, but for those named as the counts where counts are asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import fresh_name, materialise, mix, slices, table

LEAST_CHARS, LEAST_DOCS = 20, 3
SHARD_KEYS = 50_000
BROADCAST_KEYS = 2_000_000
_BLANK = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
_MASK = (1 << 64) - 1


def line_hash(line: str, least: int = LEAST_CHARS) -> int | None:
    """128-bit hash of a line's key, or None if the key is short."""
    key = line.strip(_BLANK)
    return xxhash.xxh3_128_intdigest(key.translate(_LOWER).encode()) if len(key) >= least else None


def _split(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x >> 64 for x in hashes], dtype=np.uint64), np.array([x & _MASK for x in hashes], dtype=np.uint64)


class PerfectHash:
    """Minimal perfect hash of distinct unsigned 64-bit keys: a displacement for each bucket of about four keys.

    A displacement d >= 0 puts a key on slot mix(key + d * odd) mod n; d < 0 names the slot -1 - d of a lone key.
    """

    ODD = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, displacement: np.ndarray, n: int):
        self.displacement, self.n = displacement, n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = max(1, n // 4)
        of = (mix(keys) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        size = np.bincount(of, minlength=buckets)
        start = np.concatenate([[0], np.cumsum(size)])
        free = np.ones(n, dtype=bool)
        out = np.zeros(buckets, dtype=np.int32)
        tries = np.arange(64, dtype=np.uint64)
        for b in np.argsort(-size, kind="stable").tolist():
            own = keys[order[start[b] : start[b + 1]]]
            if not len(own):
                break
            if len(own) == 1:
                continue
            base = np.uint64(0)
            while True:
                slots = (mix(own[None, :] + (base + tries)[:, None] * cls.ODD) % np.uint64(n)).astype(np.int64)
                good = free[slots].all(axis=1)
                for k in np.flatnonzero(good).tolist():
                    if len(set(slots[k].tolist())) == len(own):
                        break
                else:
                    base += np.uint64(64)
                    continue
                free[slots[k]] = False
                out[b] = int(base) + k
                break
        spare = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(size == 1).tolist():
            out[b] = -1 - next(spare)
        return cls(out, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        d = self.displacement[(mix(keys) % np.uint64(len(self.displacement))).astype(np.int64)].astype(np.int64)
        moved = (mix(keys + np.maximum(d, 0).astype(np.uint64) * self.ODD) % np.uint64(self.n)).astype(np.int64)
        return np.where(d < 0, -1 - d, moved)


class Shard:
    """One shard's arrays by slot: fingerprints, counts of documents, largest doc_ids.

    Lines that share their first 64 bits with another line can't both have a slot; they follow after the slots.
    """

    def __init__(self, displacement: bytes, prints: bytes, counts: bytes, last: bytes, firsts: bytes):
        self.prints, self.counts, self.last = np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.int32), np.frombuffer(last, np.int64)
        self.firsts = np.frombuffer(firsts, np.uint64)
        self.hash = PerfectHash(np.frombuffer(displacement, np.int32), len(self.prints) - len(self.firsts))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the shard, and the largest doc_id of each."""
        at = self.hash.slots(h1)
        found = self.prints[at] == h2
        for k, first in enumerate(self.firsts, self.hash.n):
            also = (h1 == first) & (h2 == self.prints[k])
            at[also], found[also] = k, True
        return found, self.last[at]


_ARRAYS = ("displacement", "prints", "counts", "last", "firsts")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = pdf["h1"].to_numpy(np.int64).view(np.uint64), pdf["h2"].to_numpy(np.int64).view(np.uint64)
    lead = np.zeros(len(h1), dtype=bool)
    lead[np.unique(h1, return_index=True)[1]] = True
    slots = PerfectHash.build(h1[lead])
    at = np.zeros(len(h1), np.int64)
    at[lead] = slots.slots(h1[lead])
    at[~lead] = np.arange(lead.sum(), len(h1))
    prints, counts, last = np.zeros(len(h1), np.uint64), np.zeros(len(h1), np.int32), np.zeros(len(h1), np.int64)
    prints[at], counts[at], last[at] = h2, np.minimum(pdf["n"], 2**31 - 1), pdf["last"]
    made = (slots.displacement, prints, counts, last, h1[~lead])
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]]} | {k: [v.tobytes()] for k, v in zip(_ARRAYS, made, strict=True)})


def shared_lines(df: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h1, h2, n, last) of the line keys that at least `least_docs` documents hold."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, out = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {h for x in (text.as_py() or "").split("\n") if (h := line_hash(x, least_chars)) is not None}
                out += own
                ids += [doc] * len(own)
            h1, h2 = _split(out)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids, pa.int64())], names=["h1", "h2", "doc_id"])

    lines = df.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(hashes, "h1 long, h2 long, doc_id long")
    counted = lines.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
    return counted.where(F.col("n") >= least_docs)


def dedup_lines(df: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, broadcast_keys: int = BROADCAST_KEYS, shard_keys: int = SHARD_KEYS, counts: bool = True) -> DataFrame:
    """df with text less its shared lines, and with n_lines and n_dropped if counts are asked for."""
    df = df.drop("n_lines", "n_dropped") if counts else df
    spark = df.sparkSession
    keys = materialise(shared_lines(df, least_chars, least_docs))
    n = keys.count()
    count = max(1, -(-n // shard_keys))
    shards = keys.withColumn("shard", F.pmod(F.xxhash64("h1"), F.lit(count)).cast("int")).groupBy("shard").applyInPandas(_build, "shard int, " + ", ".join(f"{k} binary" for k in _ARRAYS))
    if n <= broadcast_keys:
        built = {r.shard: tuple(bytes(r[k]) for k in _ARRAYS) for r in shards.collect()} if n else {}
        return _probe_broadcast(df, spark.sparkContext.broadcast(built), count, least_chars, counts)
    return _probe_routed(df, shards, count, least_chars, counts)


def _counted_schema(df: DataFrame, counts: bool):
    return df.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema if counts else df.schema


def _shard_of(h1: np.ndarray, count: int) -> np.ndarray:
    """Spark's xxhash64 of a long with seed 42, modulo; vectorised."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.full(len(h1), np.uint64(42) + p5 + np.uint64(8), dtype=np.uint64)
        h ^= rot(h1 * p2, 31) * p1
        h = rot(h, 27) * p1 + p4
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> np.uint64(32)
    return h.view(np.int64) % count


def _probe_broadcast(df: DataFrame, shared, count: int, least_chars: int, counts: bool) -> DataFrame:
    names = df.columns
    id_at, text_at = names.index("doc_id"), names.index("text")
    schema = _counted_schema(df, counts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {k: Shard(*v) for k, v in shared.value.items()}
        for batch in slices(batches):
            lines, hashes, doc, at = [], [], [], []
            ids, texts = batch.column(id_at).to_pylist(), batch.column(text_at).to_pylist()
            for row, (i, t) in enumerate(zip(ids, texts, strict=True)):
                own = (t or "").split("\n")
                lines.append(len(own))
                if i is None or not shards:
                    continue
                for k, x in enumerate(own):
                    h = line_hash(x, least_chars)
                    if h is not None:
                        hashes.append(h)
                        doc.append(i)
                        at.append((row, k))
            drops: dict[int, set[int]] = {}
            if hashes:
                h1, h2 = _split(hashes)
                to, who = _shard_of(h1, count), np.array(doc, np.int64)
                for s in np.unique(to).tolist():
                    if s not in shards:
                        continue
                    rows = np.flatnonzero(to == s)
                    found, last = shards[s].probe(h1[rows], h2[rows])
                    for j in rows[found & (last != who[rows])].tolist():
                        drops.setdefault(at[j][0], set()).add(at[j][1])
            for row, gone in drops.items():
                texts[row] = "\n".join(x for k, x in enumerate(texts[row].split("\n")) if k not in gone)
            cols = list(batch.columns)
            cols[text_at] = pa.array(texts, pa.string())
            if counts:
                cols += [pa.array(lines, pa.int64()), pa.array([len(drops.get(r, ())) for r in range(len(ids))], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(work, schema)


def _probe_routed(df: DataFrame, shards: DataFrame, count: int, least_chars: int, counts: bool, group: int = 200_000) -> DataFrame:
    """The probes go to the shards, `group` or so to a salt, and what is to be dropped comes back by document."""
    names = df.columns
    at, gone_name = fresh_name(df, "row"), fresh_name(df, "gone")
    keyed = df.withColumn(at, F.xxhash64("text"))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row, hashes = [], [], []
            for i, r, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {h for x in (t or "").split("\n") if (h := line_hash(x, least_chars)) is not None}
                hashes += own
                doc += [i] * len(own)
                row += [r] * len(own)
            h1, h2 = _split(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc_id", "_row", "h1", "h2"])

    sent = materialise(keyed.where(F.col("doc_id").isNotNull()).select("doc_id", at, "text").mapInArrow(probes, "doc_id long, _row long, h1 long, h2 long"))
    salts = max(1, -(-sent.count() // (count * group)))
    sent = sent.withColumn("shard", F.pmod(F.xxhash64("h1"), F.lit(count)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    spread = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left.iloc[:0][["doc_id", "_row", "h1", "h2"]]
        found, last = Shard(*(right[k].iloc[0] for k in _ARRAYS)).probe(left["h1"].to_numpy(np.int64).view(np.uint64), left["h2"].to_numpy(np.int64).view(np.uint64))
        return left[found & (last != left["doc_id"].to_numpy())][["doc_id", "_row", "h1", "h2"]]

    told = sent.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(answer, "doc_id long, _row long, h1 long, h2 long")
    by_doc = told.distinct().groupBy("doc_id", "_row").agg(F.collect_list(F.struct("h1", "h2")).alias(gone_name)).withColumnRenamed("_row", at)
    joined = keyed.join(by_doc, ["doc_id", at], "left").select(*names, gone_name)
    text_at = names.index("text")
    schema = _counted_schema(df, counts)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = batch.column(text_at).to_pylist(), [], []
            for row, gone in enumerate(batch.column(len(names)).to_pylist()):
                own = (texts[row] or "").split("\n")
                lines.append(len(own))
                bad = {(g["h1"] & _MASK) << 64 | (g["h2"] & _MASK) for g in gone or ()}
                kept = [x for x in own if line_hash(x, least_chars) not in bad] if bad else own
                dropped.append(len(own) - len(kept))
                if bad:
                    texts[row] = "\n".join(kept)
            cols = list(batch.columns[: len(names)])
            cols[text_at] = pa.array(texts, pa.string())
            if counts:
                cols += [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.mapInArrow(rebuild, schema)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, r, k, ls[k] AS line,
         translate(regexp_replace(regexp_replace(ls[k], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(range(1, len(ls) + 1)) AS u(k)),
s AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.doc_id, r, k, line, s.key IS NOT NULL AND s.last <> l.doc_id AND l.doc_id IS NOT NULL AS gone FROM l LEFT JOIN s ON l.key = s.key)
SELECT max(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""
