"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, and each half has its own codebook (k-means on a bounded sample). A vector's cell is
its pair of nearest centroids, and entries are kept by cell: each part of PART entries or so is a run of cells, and a cell
of more entries is dealt into parts of its own. A query ranks both codebooks by squared distance and walks the pairs of
ranks with a heap, smallest sum first, until the cells walked hold the budget of entries. It travels to the parts that
hold those cells, with the list of them, and is compared there with their entries and no others, by exact distance in
double precision.

Vectors that are equal share one entry, which keeps their smallest ids, as many as any answer can take (k + 1); equal
query vectors share one walk. So a vector that a third of all rows hold is neither a large cell nor many queries. The
budget is a share of all entries, at every size, and at least LEAST. The share is what recall asks for: vectors without
structure (nearest at 1.05, median at 1.41) need about 0.26 for 0.92 with 256 centroids a half, and more with fewer.
Reranking is therefore a share of entries times queries, as any search at this recall of such vectors is.

Codebooks, the numbers of entries by cell and the parts of cells (at most CENTROIDS squared) are broadcast. A part that
more than BLOCK queries go to is copied for each block of them; a task has one part and one block, and gives the k + 1
nearest of each query. Neither entries nor queries come to the driver.

Vectors that are null, zero, of another length than most, or with null or non-finite parts take no part: they neither
ask nor answer. Vectors of one component have an empty half. Rows with a null vec_id take no part either. Rows that repeat
a vec_id with the same vector are one candidate; a vec_id with several vectors asks with each and answers with each, and
the smaller distance counts for each pair of ids. Ties go to the smaller vec_id. Empty tables give no rows; further columns
take no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import materialise, table

#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 12_000
CENTROIDS = 256
K = 10
#: Entries that a query's walk gathers: this share of all, and at least LEAST.
SHARE, LEAST = 0.32, 200
#: Entries and queries that one task has, or so.
PART, BLOCK = 8_000, 4_000
EVERY = 100


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def fit_codebook(x: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    """k-means from a k-means++ start; fewer centres where there are fewer distinct vectors."""
    rng = np.random.default_rng(seed)
    if not x.shape[1]:
        return x[:1]
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    centres = x[[rng.integers(len(x))]]
    near = squared_distances(x, centres)[:, 0]
    while len(centres) < k:
        centres = np.vstack([centres, x[rng.choice(len(x), p=near / near.sum())]])
        near = np.minimum(near, squared_distances(x, centres[-1:])[:, 0])
    for _ in range(rounds):
        own = squared_distances(x, centres).argmin(1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


class MultiIndex:
    """Two codebooks, the number of entries of each cell, and the parts that hold them."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.sizes = np.zeros((len(left), len(right)), np.int64)

    def deal(self, most: int) -> None:
        """Parts: runs of cells with `most` entries or so; a cell of more has parts of its own, its first and how many."""
        sizes = self.sizes.reshape(-1)
        self.first, self.shares = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32)
        part, held = 0, 0
        for cell in np.flatnonzero(sizes).tolist():
            n = int(sizes[cell])
            if held and held + n > most:
                part, held = part + 1, 0
            self.first[cell], self.shares[cell] = part, max(1, -(-n // most))
            held += n
            if n > most:
                part, held = part + int(self.shares[cell]), 0
        self.parts = part + 1

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell numbers of vectors."""
        half = self.left.shape[1]
        return squared_distances(x[:, :half], self.left).argmin(1) * len(self.right) + squared_distances(x[:, half:], self.right).argmin(1)

    def walk(self, q: np.ndarray, budget: int) -> list[int]:
        """Cells with entries, by summed distance, until they hold `budget` entries (multi-sequence traversal)."""
        half = self.left.shape[1]
        a, b = squared_distances(q[None, :half], self.left)[0], squared_distances(q[None, half:], self.right)[0]
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, sizes = a[i].tolist(), b[j].tolist(), self.sizes[np.ix_(i, j)].tolist()
        heap, out, gathered = [(a[0] + b[0], 0, 0)], [], 0
        while heap and gathered < budget:
            _, x, y = heapq.heappop(heap)
            if sizes[x][y]:
                out.append(int(i[x]) * len(self.right) + int(j[y]))
                gathered += sizes[x][y]
            # a pair is reached from its left neighbour, and one in the first column from above
            if y + 1 < len(b):
                heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))
            if not y and x + 1 < len(a):
                heapq.heappush(heap, (a[x + 1] + b[0], x + 1, 0))
        return out


def nearest(q: np.ndarray, walks: list[np.ndarray], v: np.ndarray, cells: np.ndarray, ids: list[np.ndarray], k: int, step: int = 256) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query the nearest entries of the cells it walks: (entries, exact distances), ascending, with k + 1 ids at least if there are so many.

    Also how many distances were taken. Entries may come in any order.
    """
    order = np.argsort(cells, kind="stable")
    held, start = np.unique(cells[order], return_index=True)
    end = np.append(start[1:], len(cells))
    v, ids = v[order], [ids[e] for e in order.tolist()]
    own, many, out, taken = (v * v).sum(1), np.array([len(x) for x in ids]), [], 0
    for at in range(0, len(q), step):
        part = q[at : at + step]
        d2 = np.full((len(part), len(v)), np.inf)
        asked = walks[at : at + step]
        who, what = np.repeat(np.arange(len(part)), [len(w) for w in asked]), np.searchsorted(held, np.concatenate(asked))
        turn = np.argsort(what, kind="stable")
        who, what = who[turn], what[turn]
        edge = np.flatnonzero(np.diff(what, prepend=-1, append=-1))
        square = (part * part).sum(1)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            # one inverted list, and all queries that walk it
            rows, s, e = who[a:b], start[what[a]], end[what[a]]
            d2[rows, s:e] = square[rows][:, None] + own[None, s:e] - 2 * part[rows] @ v[s:e].T
            taken += (b - a) * int(e - s)
        for j, row in enumerate(d2):
            reach = int(np.isfinite(row).sum())
            m = min(reach, 2 * k + 2)
            while m:
                edge = np.partition(row, m - 1)[m - 1]
                near = np.flatnonzero(row <= edge + 1e-9 * (1 + abs(edge)))
                if m == reach or len({i for e in near for i in ids[e]} if many[near].min() == 1 else range(int(many[near].sum()))) > k:
                    break
                m = min(reach, 2 * m)
            if not m:
                out.append((np.zeros(0, np.int64), np.zeros(0)))
                continue
            delta = v[near] - part[j]
            score = np.sqrt((delta * delta).sum(1))
            by = np.argsort(score, kind="stable")
            out.append((order[near[by]], score[by]))
    return out, taken


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vector)
    good = v.isNotNull() & F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are one value
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double"))).alias("v"))


def search(df: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, share: float = SHARE, least: int = LEAST, sample: int = SAMPLE, part: int = PART, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of df found for each row of queries, without the query's own id."""
    spark = df.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(df, key, vector)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return none
    d = common[0].d
    rows = rows.where(F.size("v") == d)
    asked = materialise(usable(queries, key, vector).where(F.size("v") == d).distinct())
    # equal vectors: one entry with the smallest ids
    order = Window.partitionBy("v").orderBy("id")
    entries = materialise(rows.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    picked = entries.orderBy(F.xxhash64("v"), "v").limit(sample).toArrow().column("v")
    if not len(picked):
        return none
    x = np.array(picked.to_pylist(), float)
    half = d // 2
    index = MultiIndex(fit_codebook(x[:, :half], centroids, 1), fit_codebook(x[:, half:], centroids, 2))
    books = spark.sparkContext.broadcast((index.left, index.right))

    def matrix(vectors: pa.Array) -> np.ndarray:
        return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MultiIndex(*books.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.cells(matrix(batch.column(0))).astype(np.int32))], names=["v", "ids", "cell"])

    entries = materialise(entries.mapInArrow(place, "v array<double>, ids array<long>, cell int"))
    for cell, n in entries.groupBy("cell").count().collect():
        index.sizes[cell // len(index.right), cell % len(index.right)] = n
    index.deal(part)
    budget = max(least, math.ceil(share * int(index.sizes.sum())))
    shared = spark.sparkContext.broadcast(index)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at, parts, walks = [], [], []
            for row, q in enumerate(matrix(batch.column(2))):
                cells = np.array(sorted(own.walk(q, budget)), np.int32)
                # cells of several parts are asked for in each; the others come in runs of one part
                first, shares = own.first[cells], own.shares[cells]
                edge = np.flatnonzero(np.diff(first, prepend=-1, append=-1))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    for extra in range(int(shares[a])):
                        at.append(row)
                        parts.append(int(first[a]) + extra)
                        walks.append(cells[a:b])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array(parts, pa.int32()), pa.array(walks, pa.list_(pa.int32()))], names=["q1", "q2", "qv", "part", "cells"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            cell, turn = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((own.first[cell] + turn % own.shares[cell]).astype(np.int32))], names=["v", "ids", "cell", "part"])

    # a query is named by two hashes of its vector
    named = asked.withColumns({"q1": F.xxhash64("v"), "q2": F.xxhash64(F.lit(9), "v")})
    questions = named.groupBy("q1", "q2").agg(F.first("v").alias("qv"))
    walked = materialise(questions.repartition("q1", "q2").mapInArrow(route, "q1 long, q2 long, qv array<double>, part int, cells array<int>"))
    stored = entries.withColumn("turn", F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 30))).mapInArrow(store, "v array<double>, ids array<long>, cell int, part int")

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            ids = right["ids"].tolist()
            best, _ = nearest(np.stack(left["qv"].tolist()), left["cells"].tolist(), np.stack(right["v"].tolist()), right["cell"].to_numpy(), ids, k)
            for q1, q2, (near, score) in zip(left["q1"], left["q2"], best, strict=True):
                out += [(q1, q2, int(i), float(s)) for e, s in zip(near.tolist(), score, strict=True) for i in ids[e]]
        return pd.DataFrame(out, columns=["q1", "q2", "vec_id", "score"])

    blocks = materialise(walked.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    asking = walked.join(blocks, "part").withColumn("block", F.pmod(F.col("q1"), F.col("blocks")).cast("int")).drop("blocks")
    asks = stored.join(blocks, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = asking.groupBy("part", "block").cogroup(asks.groupBy("part", "block")).applyInPandas(rank, "q1 long, q2 long, vec_id long, score double")
    near = Window.partitionBy("q1", "q2").orderBy("score", "vec_id")
    best = found.groupBy("q1", "q2", "vec_id").agg(F.min("score").alias("score")).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).drop("r")
    answers = named.select(F.col("id").alias("query_id"), "q1", "q2").join(best, ["q1", "q2"]).where(F.col("query_id") != F.col("vec_id"))
    answers = answers.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_imi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))
