"""Alignment of two tokenizers over the same bytes, by products of sparse incidence matrices.

A text's tokens under either tokenizer are rows of a matrix over byte places: token i has a one where its bytes are. Held
as CSR arrays, the product A * B-transposed has an entry for each pair of tokens whose ranges overlap (its value counts the
bytes they share): an overlap link. It is taken row by row (Gustavson): each place of an A row brings the row of the
transposed B that stands there, and equal columns are added up. Where tokens of both end, the bytes are cut into groups;
incidences of tokens and groups, multiplied the same way, give the pairs that share a group, and their rows list the
groups' tokens.

1. Texts are parted at single spaces between plain characters. There both tokenizers part too (the first splits text
   before a space, and no piece of the second holds a space after another character, which is checked on loading), so
   that a part's tokens, links and groups are those it has in the text. Parts that a worker has seen are kept, up to a
   number of bytes; new ones are tokenised and multiplied together, as blocks of one matrix.
2. Each document's distinct linked id pairs and how often they occur are written to shared storage, and Spark counts the
   documents of each pair and finds each A id's highest count.
3. Pairs held by a share of all (document, pair) rows large enough that at most MOST pairs can have it are broadcast; the
   rest, none of them hot, is joined by pair and summed by row.

Null and empty texts, and texts whose joined A or B bytes differ from space+text, have no tokens: zeros and an empty
digest. Every row is a document: repeated rows each count in a pair's documents and each get a row; a null doc_id stays.
Further columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import materialise, slices, table, trim
from weft.llm.op4_bpe import PATTERN, byte_letters

#: Most pairs that are broadcast (17 bytes each).
MOST = 500_000
#: A worker forgets its parts at about so many bytes; new parts are multiplied in blocks of about so many.
KEPT_BYTES, BLOCK_BYTES = 64 << 20, 1 << 19
#: Parts of more characters than this go to the library that reads the file itself.
LONG_PART = 1_000
#: A space between characters that no tokenizer takes for blanks or joins to them.
_CUT = re.compile("(?<=[!-~¡-¬®-ɏ]) (?=[!-~¡-¬®-ɏ])")


@dataclass
class Csr:
    """A sparse matrix of counts by rows: row i has columns indices[indptr[i]:indptr[i + 1]], with the values data."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @classmethod
    def of(cls, rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int]) -> Csr:
        """Ones at distinct (rows, cols), in any order."""
        if len(rows) and (np.diff(rows) < 0).any():
            order = np.argsort(rows, kind="stable")
            rows, cols = rows[order], cols[order]
        return cls(np.searchsorted(rows, np.arange(shape[0] + 1)), cols, np.ones(len(cols), np.int64), shape[1])

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        return Csr(np.searchsorted(self.indices[order], np.arange(self.columns + 1)), self.rows[order], self.data[order], len(self.indptr) - 1)

    def __matmul__(self, other: Csr) -> Csr:
        """Row products: each entry of a row brings the other's row of its column; equal columns are added up."""
        size = np.diff(other.indptr)[self.indices]
        total = int(size.sum())
        if not total:
            return Csr(np.zeros(len(self.indptr), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), other.columns)
        entry = np.repeat(np.arange(len(size)), size)
        at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + other.indptr[self.indices][entry]
        key = self.rows[entry] * other.columns + other.indices[at]
        value = self.data[entry] * other.data[at]
        if (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rows, cols = np.divmod(key[first], other.columns)
        return Csr(np.searchsorted(rows, np.arange(len(self.indptr))), cols, np.add.reduceat(value, first), other.columns)


def byte_incidence(ends: np.ndarray) -> Csr:
    """Tokens by byte places, for tokens that end at `ends` and stand one after another."""
    size = np.diff(ends, prepend=0)
    n = int(ends[-1]) if len(ends) else 0
    return Csr.of(np.repeat(np.arange(len(ends)), size), np.arange(n), (len(ends), n))


def overlap_links(a_ends: np.ndarray, b_ends: np.ndarray) -> Csr:
    """A tokens by B tokens that share bytes; values are how many."""
    return byte_incidence(a_ends) @ byte_incidence(b_ends).transposed()


def group_incidence(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[Csr, Csr]:
    """Tokens of A and of B by the group they are in; groups end where both end."""
    cuts = np.intersect1d(a_ends, b_ends)

    def tokens(ends: np.ndarray) -> Csr:
        return Csr.of(np.arange(len(ends)), np.searchsorted(cuts, ends), (len(ends), len(cuts)))

    return tokens(a_ends), tokens(b_ends)


def group_links(a_ends: np.ndarray, b_ends: np.ndarray) -> Csr:
    """A tokens by B tokens of the same group."""
    a, b = group_incidence(a_ends, b_ends)
    return a @ b.transposed()


class ByteBpe:
    """Ids and token bytes of a byte-level vocabulary file; special tokens' strings are plain text."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][m] for m in merges]
        if made != sorted(made):
            raise ValueError("ids must follow the order of merges")
        self.arcs = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.arcs[i] = t
        self._fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_PART:
            return self._fast.encode_ordinary(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True
            self._library.no_truncation()
            self._library.no_padding()
        return self._library.encode(text, add_special_tokens=False).ids


class PieceBpe:
    """Ids and token bytes of a piece vocabulary with byte fallback, which puts a space before texts."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        #: may texts be parted at single spaces?
        self.parts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.arcs = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


class Aligner:
    """Aligns texts part by part; keeps what it has learnt of parts, in flat arrays by number."""

    def __init__(self, a_path: str, b_path: str, kept_bytes: int = KEPT_BYTES):
        self.a, self.b, self.kept_bytes = ByteBpe(a_path), PieceBpe(b_path), kept_bytes
        self._a_size, self._b_size = (np.array([len(x) for x in t.arcs], np.int64) for t in (self.a, self.b))
        self._names = [[f"{i}{end}" for i in range(max(len(self.a.arcs), len(self.b.arcs)))] for end in (",", "|", ";")]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts, self.start = np.zeros((0, len(_COUNTS)), np.int64), np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes = 0

    def split(self, text: str) -> list[str]:
        return _CUT.split(text) if self.b.parts else [text]

    def learn(self, parts: list[str]) -> None:
        """Tokenise and align parts that aren't known, in blocks."""
        new, size = [], 0
        for p in parts:
            new.append(p)
            size += len(p)
            if size >= BLOCK_BYTES:
                self._learn(new)
                new, size = [], 0
        if new:
            self._learn(new)

    def _learn(self, parts: list[str]) -> None:
        a_ids, b_ids = [self.a.encode(" " + p) for p in parts], self.b.encode(parts)
        # a part that either doesn't give back has no tokens, and nor does any text with it
        fits = []
        for p, x, y in zip(parts, a_ids, b_ids, strict=True):
            want = b" " + p.encode()
            fits.append(b"".join(map(self.a.arcs.__getitem__, x)) == want and b"".join(map(self.b.arcs.__getitem__, y)) == want)
        a_ids, b_ids = ([x if ok else [] for x, ok in zip(ids, fits, strict=True)] for ids in (a_ids, b_ids))
        n = len(parts)
        a, b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (a_ids, b_ids))
        a_part, b_part = (np.repeat(np.arange(n), [len(x) for x in ids]) for ids in (a_ids, b_ids))
        # parts follow one another in the rows and columns: the blocks of one matrix
        a_ends, b_ends = np.cumsum(self._a_size[a]), np.cumsum(self._b_size[b])
        links = overlap_links(a_ends, b_ends)
        rows = links.rows
        part = a_part[rows]
        # each part's distinct pairs, and how often they are linked
        pair = a[rows] << 32 | b[links.indices]
        order = np.lexsort((pair, part))
        part_, pair_ = part[order], pair[order]
        first = np.flatnonzero(np.concatenate([[True], (part_[1:] != part_[:-1]) | (pair_[1:] != pair_[:-1])])) if len(pair_) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(pair_)))
        a_group, b_group = group_incidence(a_ends, b_ends)
        by_a, by_b = a_group.transposed(), b_group.transposed()
        group_part = a_part[by_a.indices[by_a.indptr[:-1]]]
        shared = np.diff(by_a.indptr) * np.diff(by_b.indptr)
        counts = np.stack([np.bincount(a_part, minlength=n), np.bincount(b_part, minlength=n), np.bincount(group_part, minlength=n), np.bincount(part, minlength=n), np.bincount(group_part, shared, minlength=n)], axis=1).astype(np.int64)
        texts = self._listed(a, b, a_group, b_group, by_a, by_b, a_part, b_part, n)

        for p, ok in zip(parts, fits, strict=True):
            self.known[p] = len(self.known) if ok else -1 - len(self.known)
        self.groups += texts
        self.counts = np.concatenate([self.counts, counts])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.bincount(part_[first], minlength=n))])
        self.pairs, self.times = np.concatenate([self.pairs, pair_[first]]), np.concatenate([self.times, times])
        self.bytes += sum(map(len, parts)) + sum(map(len, texts)) + 16 * len(first) + 350 * n

    def _listed(self, a, b, a_group: Csr, b_group: Csr, by_a: Csr, by_b: Csr, a_part, b_part, n: int) -> list[str]:
        """Each part's groups as a1,a2|b1;a3|b2,b3."""
        comma, bar, semicolon = self._names
        a_last, b_last = (by.indptr[g.indices + 1] - 1 == np.arange(len(g.indices)) for by, g in ((by_a, a_group), (by_b, b_group)))
        names = [bar[i] if last else comma[i] for i, last in zip(a.tolist(), a_last.tolist(), strict=True)]
        names += [semicolon[i] if last else comma[i] for i, last in zip(b.tolist(), b_last.tolist(), strict=True)]
        group = np.concatenate([a_group.indices, b_group.indices])
        order = np.argsort(2 * group + np.repeat([0, 1], [len(a), len(b)]), kind="stable").tolist()
        ends = np.cumsum(np.bincount(a_part, minlength=n) + np.bincount(b_part, minlength=n)).tolist()
        ordered = [names[k] for k in order]
        return ["".join(ordered[s:e])[:-1] for s, e in zip([0, *ends], ends, strict=False)]

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """For each text its counts, groups, linked pairs (A id << 32 | B id, ascending) and how often each is linked."""
        if self.bytes > self.kept_bytes:
            self.forget()
        split = [self.split(t) if t else [] for t in texts]
        self.learn(list(dict.fromkeys(p for parts in split for p in parts if p not in self.known)))
        none = np.zeros(0, np.int64)
        for parts in split:
            at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
            if not len(at) or (at < 0).any():
                yield np.zeros(len(_COUNTS), np.int64), "", none, none
                continue
            own, often = np.unique(at, return_counts=True)
            size = self.start[own + 1] - self.start[own]
            places = np.arange(int(size.sum())) + np.repeat(self.start[own] - (np.cumsum(size) - size), size)
            pairs, back = np.unique(self.pairs[places], return_inverse=True)
            times = np.bincount(back, self.times[places] * np.repeat(often, size), minlength=len(pairs)).astype(np.int64)
            yield (self.counts[own] * often[:, None]).sum(axis=0), ";".join(map(self.groups.__getitem__, at.tolist())), pairs, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def _batches(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` characters of text together; a longer text stands alone."""
    for batch in slices(batches):
        start, size = 0, 0
        for k, t in enumerate(batch.column(1)):
            n = len(t.as_py() or "")
            if k > start and size + n > most:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def align_documents(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, and the linked pairs with their times."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _ALIGNERS.get((a_path, b_path))
        if own is None:
            own = _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
        for batch in _batches(batches):
            counts, digests, pairs, times = [], [], [], []
            for c, groups, p, t in own.align(batch.column(1).to_pylist()):
                counts.append(c)
                digests.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                pairs.append(p)
                times.append(t)
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in np.array(counts).T), pa.array(digests, pa.string()), _lists(pairs), _lists(times)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *_COUNTS, "groups_sha256", "pairs", "times"])
            trim()

    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, pairs array<long>, times array<long>"
    return df.select("doc_id", "text").mapInArrow(work, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows hold each linked pair, and whether that is the most of its A id."""
    counted = materialise(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", 32)))
    # one row for each id of the first vocabulary
    top = counted.groupBy("a").agg(F.max("n").alias("top"))
    return counted.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def scored_documents(df: DataFrame, a_path: str, b_path: str, most: int = MOST) -> DataFrame:
    """align_documents() less the pairs, with n_best and count_sum of the whole table's pair counts."""
    spark = df.sparkSession
    aligned = materialise(align_documents(df, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    counts = materialise(pair_counts(aligned))
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    least = 1 if distinct <= most else -(-total // most)
    frequent = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast((frequent.column("pair").to_numpy(), frequent.column("n").to_numpy(), frequent.column("best").to_numpy(zero_copy_only=False)))
    keep = ["doc_id", *_COUNTS, "groups_sha256", "row"]
    schema = aligned.select(*keep).schema.add("n_best", "long").add("count_sum", "long").add("rest", aligned.schema["pairs"].dataType).add("rest_times", aligned.schema["times"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for pairs, times in zip(batch.column(len(keep)), batch.column(len(keep) + 1), strict=True):
                p, t = pairs.values.to_numpy(), times.values.to_numpy()
                at = np.minimum(np.searchsorted(known, p), len(known) - 1) if len(known) else np.zeros(len(p), np.int64)
                hit = known[at] == p if len(known) else np.zeros(len(p), bool)
                out[0].append(int((t * best[at])[hit].sum()) if len(known) else 0)
                out[1].append(int((t * n[at])[hit].sum()) if len(known) else 0)
                out[2].append(p[~hit])
                out[3].append(t[~hit])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), _lists(out[2]), _lists(out[3])], names=schema.names)

    told = aligned.select(*keep, "pairs", "times").mapInArrow(work, schema)
    if least == 1:
        return told.drop("row", "rest", "rest_times")
    told = materialise(told)
    rare = told.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("t"))
    more = rare.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more_sum"))
    joined = told.join(more, "row", "left")
    return joined.select("doc_id", *_COUNTS, "groups_sha256", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scored_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
