"""All labelled documents that a model may learn from, with a weight for copies, and fits by sums over all of them.

What comes to the driver are sums of a size that the model sets, not the number of rows. Sums are of whole numbers, and
so are the same with every partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import as_long, crc_class, materialise, mix, text_blocks, word_hashes

#: Weight of a document that has no copies.
ONE = 1 << 20
#: What a sum of fractions is counted in.
UNIT = float(1 << 24)
#: Bins that a quantile's range is cut into in each of ROUNDS rounds.
BINS, ROUNDS = 256, 4
HASHES = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)


def min_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES min-hashes of the word triples of each text of a block; of texts under three words a hash of the text."""
    h, first = word_hashes(data, offsets)
    rows = len(offsets) - 1
    out = np.empty((rows, HASHES), np.uint64)
    triples = mix(mix(h[:-2] * _STEP + h[1:-1]) * _STEP + h[2:]) if len(h) > 2 else np.zeros(0, np.uint64)
    long = np.flatnonzero(np.diff(first) > 2)
    # a row's triples end two words before its end: what lies between rows is never the least
    inner = np.zeros(len(triples), bool)
    edge = np.zeros(len(triples) + 1, np.int64)
    np.add.at(edge, first[long], 1)
    np.add.at(edge, first[long + 1] - 2, -1)
    inner[:] = np.cumsum(edge)[:-1] > 0
    for k in range(HASHES):
        if len(long):
            v = np.where(inner, mix(triples ^ np.uint64((k + 1) * int(_STEP) & (1 << 64) - 1)), np.uint64(2**64 - 1))
            out[long, k] = np.minimum.reduceat(v, first[long])
    for r in np.flatnonzero(np.diff(first) <= 2).tolist():
        out[r] = xxhash.xxh3_64_intdigest(data[offsets[r] : offsets[r + 1]].tobytes())
    return out


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, y, weight) of all labelled documents whose crc32 class isn't held out, and the classes' sizes.

    Rows of a class that share one of three min-hashes share a weight of about ONE, so that large groups of copies don't
    pass for evidence, and none is left out. The copies are found by row numbers and hashes, without the texts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (crc_class(F.col("doc_id"), modulus) != held_out)).groupBy("doc_id").agg(F.max(column).cast("int").alias("y")).where("y IN (0, 1)")
    known = materialise(known)
    sizes = dict(known.groupBy("y").count().collect())
    names = [f"h{k}" for k in range(HASHES)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column(0)):
                hashes = min_hashes(data, offsets)
                n = end - row
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(serial, serial + n)), batch.column(0).slice(row, n), batch.column(1).slice(row, n), *(as_long(hashes[:, k].copy()) for k in range(HASHES))], names=["row", "text", "y", *names])
                serial += n

    mine = docs.where(F.col("text").isNotNull() & (crc_class(F.col("doc_id"), modulus) != held_out)).select("doc_id", "text").join(known, "doc_id")
    rows = materialise(mine.select("text", "y").mapInArrow(work, "row long, text string, y int, " + ", ".join(f"{n} long" for n in names)))
    seen = rows.select("row", "y", F.posexplode(F.array(*names)).alias("k", "h"))
    many = seen.groupBy("y", "k", "h").agg(F.count("*").alias("n")).where("n > 1")
    copies = seen.join(many, ["y", "k", "h"]).groupBy("row").agg(F.max("n").alias("n"))
    weight = F.greatest(F.floor(F.lit(ONE) / F.coalesce("n", F.lit(1))), F.lit(1)).cast("long")
    return materialise(rows.join(copies, "row", "left").select("text", "y", weight.alias("weight"))), {y: int(sizes.get(y, 0)) for y in (0, 1)}


def summed(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums over all tasks of the vectors of whole numbers that work() gives for a task's batches, by number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = work(batches)
        yield pa.RecordBatch.from_arrays([pa.array(list(told), pa.int32()), pa.array([np.asarray(v, float).tobytes() for v in told.values()], pa.binary())], names=["k", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

    got = df.mapInArrow(task, "k int, v binary").groupBy("k").applyInPandas(add, "k int, v binary").collect()
    return {r.k: np.frombuffer(r.v) for r in got}


def numbers(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """The first columns of a batch as doubles, one row for each of its rows."""
    return np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(columns)])


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> np.ndarray:
    """[column, share]: where so much of the weight of all rows (columns, weight) lies at or below, to 2^-32 of a column's range.

    Ranges are narrowed to the bin that holds the place, for all places at once; an edge is at or below the values it stands for.
    """
    span = df.agg(*(f(c).cast("double") for c in columns for f in (F.min, F.max))).first()
    low, high = (np.repeat(np.array([span[2 * k + j] for k in range(len(columns))], float)[:, None], len(shares), 1) for j in (0, 1))
    under = np.zeros(low.shape)  # weight below each range
    total = None
    for _ in range(ROUNDS):
        width = (high - low) / BINS

        def work(batches: Iterator[pa.RecordBatch], low: np.ndarray = low, width: np.ndarray = width, first: bool = total is None) -> dict[int, np.ndarray]:
            out = {n: np.zeros(BINS) for n in range(low.size)}
            for batch in batches:
                x = numbers(batch, len(columns) + 1)
                for n in range(low.size):
                    k, j = divmod(n, low.shape[1])
                    if first and j:  # all places start in one range
                        continue
                    at = np.floor((x[:, k] - low[k, j]) / width[k, j]) if width[k, j] > 0 else np.where(x[:, k] == low[k, j], 0.0, -1.0)
                    if first:
                        at = np.clip(at, 0, BINS - 1)
                    else:  # the range's upper edge may be the largest value
                        at = np.where((at == BINS) & (x[:, k] <= low[k, j] + width[k, j] * BINS), BINS - 1, at)
                    own = (at >= 0) & (at < BINS)
                    out[n] += np.bincount(at[own].astype(np.int64), weights=x[own, -1], minlength=BINS)
            return {n: v for n, v in out.items() if not first or n % low.shape[1] == 0}

        got = summed(df.select(*columns, "weight"), work)
        for n in range(low.size):
            k, j = divmod(n, low.shape[1])
            sums = np.cumsum(got[n if total is not None else n - j])
            whole = sums[-1] if total is None else total
            b = min(int(np.searchsorted(under[k, j] + sums, shares[j] * whole - 0.5)), BINS - 1)
            under[k, j] += sums[b - 1] if b else 0
            low[k, j] += width[k, j] * b
            high[k, j] = low[k, j] + width[k, j]
        total = sums[-1] if total is None else total
    return low


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], penalty: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The weights at which the gradient, with a penalty on squares, is zero; sums gives a loss's gradient and Hessian."""
    w = np.zeros(len(penalty))
    for _ in range(rounds):
        g, h = sums(w)
        step = np.linalg.solve(h + np.diag(penalty + 1e-9), g + penalty * w)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_logistic(df: DataFrame, columns: list[str], rate: dict[int, float], ridge: float) -> np.ndarray:
    """Weights, the last for the constant, of a ridge logistic regression over all rows (y, weight, columns); rate: a factor of each class's weights."""
    m = len(columns) + 1

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            out = np.zeros(m + m * m)
            for batch in batches:
                x = numbers(batch, m + 1)
                y, weight = x[:, 0], x[:, 1] / ONE * np.where(x[:, 0] > 0, rate[1], rate[0])
                x = np.column_stack([x[:, 2:], np.ones(len(x))])
                p = sigmoid((x * w).sum(axis=1))
                g = x * (weight * (p - y))[:, None]
                h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None])[:, :, None] * x[:, None, :]
                out += np.rint(np.column_stack([g, h.reshape(len(x), -1)]) * UNIT).sum(axis=0)
            return {0: out}

        got = summed(df.select("y", "weight", *columns), work)[0] / UNIT
        return got[:m], got[m:].reshape(m, m)

    return newton(sums, np.array([ridge] * (m - 1) + [1e-6]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
