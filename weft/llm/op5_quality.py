"""Quality by Bradley-Terry ranking: a document beats another with probability sigmoid(score difference).

Features of whole texts (lengths, shares of kinds of characters, spread of words and word pairs, share of common words)
are cut at quantiles into steps, so that a linear score can bend. Each document labelled good is a preference pair with
each one labelled bad; the logistic loss on differences of features, summed over all of these pairs, gives the weights. The raw score
is cut at the quantile that leaves as many of the learning rows above it as have label 1, and a logistic scale puts
that cut at THRESHOLD.

A pair's share in the loss depends on two scores, so that the sums over all pairs follow from each class's sums by bins
of the score: a round of Newton's method reads the documents twice, and the driver gets BINS sums a class and the Hessian.
Fitted on all labelled rows that aren't held out (copies share a weight); sums are of whole numbers, and so every
score, is the same with every partitioning. Every text, however long, is scored whole. Null texts count as empty, an
empty table gives no rows, raw scores that tie with the cut are at THRESHOLD. Without labels of both classes the score
is the share of label 1. Repeated rows each get a row; only doc_id and text are read, further columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import _LOWER, _SPACE, crc_class, materialise, table, text_blocks, word_places
from weft.llm.labelled import ONE, labelled_rows, newton, numbers, quantiles, sigmoid, summed

#: What all pairs together weigh in the loss, for each document.
PAIRS = 4.0
RIDGE = 3.0
#: Bins of the score by which pairs are summed.
BINS = 256
#: Most frequent words of the learning rows that count as common.
COMMON = 300
STEPS = 12
MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.7

_KIND = np.zeros(256, dtype=np.int64)  # 0: symbols
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:'\"?-()", "!", "|"], 1):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[128:] = 9
_KINDS = 10
NAMES = ["log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "punctuation", "lines", "beyond_ascii", "exclamations", "bars", "distinct_words", "distinct_pairs", "common_words", "letters"]


def block_features(data: np.ndarray, offsets: np.ndarray, common: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text of a block."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    h, first, s, e = word_places(data, offsets, _LOWER, _SPACE)
    words = np.diff(first)
    row_of_byte = np.repeat(np.arange(rows), size)
    kinds = np.bincount(row_of_byte * _KINDS + _KIND[data], minlength=rows * _KINDS).reshape(rows, _KINDS)
    share = kinds / np.maximum(size, 1)[:, None]
    row_of = np.repeat(np.arange(rows), words)
    word_bytes = np.bincount(row_of, weights=(e - s).astype(float), minlength=rows)

    def spread(values: np.ndarray, of: np.ndarray, counts: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        v, r = values[order], of[order]
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[new], minlength=rows) / np.maximum(counts, 1)

    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else np.zeros(0, np.uint64)
    same = row_of[:-1] == row_of[1:] if len(h) > 1 else np.zeros(0, bool)
    known = np.zeros(len(h), bool)
    if len(common) and len(h):
        known = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
    letters = kinds[:, 1] + kinds[:, 2]
    return np.column_stack([
        np.log1p(size), np.log1p(words), word_bytes / np.maximum(words, 1), kinds[:, 2] / np.maximum(letters, 1), share[:, 3], share[:, 0], share[:, 6], share[:, 5], share[:, 9], share[:, 7], share[:, 8],
        spread(h, row_of, words), spread(pair[same], row_of[:-1][same], words - 1), np.bincount(row_of, weights=known, minlength=rows) / np.maximum(words, 1), letters / np.maximum(size, 1),
    ])


class QualityModel:
    """Cuts of each feature, weights of the steps between them, common words, and the scale of scores."""

    def __init__(self, common: np.ndarray, share: float):
        self.common, self.share = common, share
        self.cuts: list[np.ndarray] = []
        self.weights: np.ndarray | None = None
        self.scale, self.shift = 1.0, 0.0

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Thermometer code: a column for each cut that a value reaches."""
        return np.column_stack([(x[:, [k]] > c[None, :]).astype(float) for k, c in enumerate(self.cuts)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.round(self.steps(x) @ self.weights, 9)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        return sigmoid(self.raw(x) * self.scale + self.shift)


def pair_sums(rows: DataFrame, model: QualityModel, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss over all pairs of a good and a bad row (NAMES, y, weight), scores taken by bins."""
    m, columns = len(w), len(NAMES)
    low, high = float(np.minimum(w, 0).sum()), float(np.maximum(w, 0).sum())
    width = max(high - low, 1e-9) / BINS

    def binned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = model.steps(x)
        return steps, np.clip(np.floor((np.round(steps @ w, 9) - low) / width), 0, BINS - 1).astype(np.int64)

    def by_bins(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out = np.zeros((2 * BINS, m + 1))
        for batch in batches:
            x = numbers(batch, columns + 2)
            steps, at = binned(x[:, :columns])
            at += x[:, columns].astype(np.int64) * BINS
            order = np.argsort(at, kind="stable")
            names, start = np.unique(at[order], return_index=True)
            if len(names):
                out[names] += np.add.reduceat((np.column_stack([steps, np.ones(len(x))]) * x[:, [-1]])[order], start)
        return {int(k): out[k] for k in np.flatnonzero(out[:, -1])}

    sums = np.zeros((2, BINS, m + 1))
    for k, v in summed(rows, by_bins).items():
        sums[k // BINS, k % BINS] = v / ONE
    bad, good = sums
    pairs = good[:, -1].sum() * bad[:, -1].sum()
    scale = PAIRS * (good[:, -1].sum() + bad[:, -1].sum()) / pairs
    lose = sigmoid(-(np.arange(BINS)[:, None] - np.arange(BINS)[None, :]) * width)  # of a good row in a bin against a bad one in another
    both = lose * (1 - lose)
    gradient = -(good[:, :m] * (lose @ bad[:, -1])[:, None]).sum(axis=0) + (bad[:, :m] * (good[:, -1] @ lose)[:, None]).sum(axis=0)
    own = np.stack([good[:, -1] @ both, both @ bad[:, -1]])  # by class and bin: what a row meets
    unit = float(ONE) / max(own.max(), 1e-300)

    def squares(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out = np.zeros((m, m))
        for batch in batches:
            x = numbers(batch, columns + 2)
            steps, at = binned(x[:, :columns])
            share = np.rint(own[x[:, columns].astype(np.int64), at] * unit * x[:, -1] / ONE)
            out += (steps * share[:, None]).T @ steps
        return dict(enumerate(out))

    told = summed(rows, squares)
    hessian = np.stack([told[k] for k in range(m)]) / unit
    cross = good[:, :m].T @ both @ bad[:, :m]
    return gradient * scale, (hessian - cross - cross.T) * scale


def fit_pairs(rows: DataFrame, model: QualityModel) -> None:
    """Bradley-Terry weights from all (good, bad) pairs of rows, then the cut at the quantile of scores that leaves the model's share above."""
    places = np.linspace(0.02, 0.98, STEPS).tolist()
    model.cuts = [np.unique(c) for c in quantiles(rows, NAMES, places)]
    model.weights = newton(lambda w: pair_sums(rows, model, w), np.full(sum(map(len, model.cuts)), RIDGE))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = numbers(batch, len(NAMES) + 2)
            yield pa.RecordBatch.from_arrays([batch.column(len(NAMES)), batch.column(len(NAMES) + 1), pa.array(model.raw(x[:, : len(NAMES)]))], names=["y", "weight", "raw"])

    raw = materialise(rows.mapInArrow(scored, "y int, weight long, raw double"))
    # copies count less: classes have their own shares again
    sums = dict(raw.groupBy("y").agg(F.sum("weight")).collect())
    of_class = F.when(F.col("y") == 1, F.lit(model.share / sums[1])).otherwise(F.lit((1 - model.share) / sums[0]))
    raw = raw.withColumn("weight", F.round(F.col("weight") * of_class * (sum(sums.values()) / ONE) * 1024))
    cut = float(quantiles(raw, ["raw"], [1 - model.share])[0, 0])
    model.scale = 1.0
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - model.scale * cut)


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    known, sizes = labelled_rows(docs, labels, "quality", MODULUS, HELD_OUT)
    total = sum(sizes.values())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                h, n = np.unique(word_places(data, offsets, _LOWER, _SPACE)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    top = known.select("text").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON).collect()
    model = QualityModel(np.sort(np.array([r.h for r in top], np.int64).view(np.uint64)), sizes.get(1, 0) / total if total else 0.0)
    common = model.common

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column(0)):
                x = block_features(data, offsets, common)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k].copy()) for k in range(len(NAMES))), batch.column(1).slice(row, end - row), batch.column(2).slice(row, end - row)], names=[*NAMES, "y", "weight"])

    rows = materialise(known.select("text", "y", "weight").mapInArrow(measured, ", ".join(f"{n} double" for n in NAMES) + ", y int, weight long"))
    if {r.y for r in rows.select("y").distinct().collect()} == {0, 1}:
        fit_pairs(rows, model)
    return model


def score_documents(df: DataFrame, model: QualityModel, key: str = "doc_id") -> DataFrame:
    """key and score of every row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column(1)):
                out = shared.value.score(block_features(data, offsets, shared.value.common))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(out)], names=[key, "score"])

    return df.select(key, "text").mapInArrow(work, f"{key} {kind}, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_class(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
