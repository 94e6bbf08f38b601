"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Spark counts words and word pairs of the training documents. The filter holds, for an n-gram of count c, the entries
(n-gram, 1) to (n-gram, q) with q = 1 + floor(log2(c / least)); a probe asks for levels 1, 2, ... until one is missing,
and so never reads less than was stored. The filter is cut into pages by n-gram hash: the tasks that count a page's
n-grams also build the page. A page takes BITS_PER_ENTRY bits for each entry, however many there are.

Texts whose pages surely fit into BROADCAST_BYTES get them as a broadcast. Of more texts, blocks of some megabytes send
their distinct n-grams to the pages once, ascending and compressed, with the counts to learn from; the task of a page
counts, builds the page, probes it and tells each block the levels of its own n-grams, and exact counts of words. No token
is stored: a block's texts meet the answers compressed, and are cut into tokens again. A frequent n-gram is one entry a block.

The score of a text is the log10 probability of its words and its end under p(w|v) = (c(vw) + M q(w)) / (c(v) + M) with
q(w) = (c(w)+1)/(N+V+1) and probed counts (M: WEIGHT). A level stands for its least count above the line and for its most
below it, so that without false probes the shares after a word sum to at most one. base_score takes exact counts. With a
broadcast filter, tokens with at least N/HEAD occurrences, of which there can be HEAD at most, are broadcast too; rarer
tokens are joined by hash, where no key has more than a HEAD-th of all.

Tokens are 64-bit hashes of words. Null texts are empty: one token, the end. Rows with null doc_id are scored, not
learned from. Repeated rows each get a row and each count. Without training rows N = V = 0 and probabilities are of one
unseen token. Further columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import crc_class, materialise, mix, table, text_blocks, word_hashes

MODULUS, HELD_OUT = 7, 2
END = np.uint64(0x1D8AF066D3A51E01)
_STEP = np.uint64(0x9E3779B97F4A7C15)
BITS_PER_ENTRY, PROBES = 12, 6
#: Pages of both filters together are broadcast up to this size.
BROADCAST_BYTES = 1 << 26
#: Tokens of text for each page of the filter, about, and bytes that a token takes. Fewer pages are fewer messages of a block.
PAGE_TOKENS, TOKEN_BYTES = 1_600_000, 6
#: Bytes of text that send their n-grams together.
SENT_BYTES = 1 << 23
#: Tokens that a task counts at once.
FLUSH_TOKENS = 2_000_000
HEAD = 200_000
#: Probes that a task answers from one page at once, about.
PAGE_PROBES = 1_600_000
#: How many observations of v the words' own distribution counts for.
WEIGHT = 2_000
LEVELS = 40


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _STEP + right)


def token_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block's rows, each row closed by END, and the rows' offsets."""
    h, first = word_hashes(data, offsets)
    counts = np.diff(first)
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(int(at[-1]), END, dtype=np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    out[np.arange(len(h)) + row] = h
    return out, at


def contexts(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token before each; END before the first."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[at[:-1]] = END
    return out


def _tallied(batches: Iterator[pa.RecordBatch], pairs: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct hashes of tokens or pairs with their counts, a few million tokens at a time."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column(0)):
            tokens, at = token_rows(data, offsets)
            held.append(pair_hash(contexts(tokens, at), tokens) if pairs else tokens)
            size += len(tokens)
            if size > FLUSH_TOKENS:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n) of all tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n in _tallied(batches, pairs=False):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.select("text").mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def page_of(h: np.ndarray, pages: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFF)) % np.uint64(pages)).astype(np.int64)


def key_of(h: np.ndarray) -> np.ndarray:
    """What a page knows an n-gram by: the 40 bits that the page isn't chosen by."""
    return h >> np.uint64(24)


def key_bytes(keys: np.ndarray) -> np.ndarray:
    """Five bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def keys_from(data: bytes, m: int) -> np.ndarray:
    """The first m keys of key_bytes()."""
    k = np.zeros((m, 8), np.uint8)
    k[:, :5] = np.frombuffer(data, np.uint8, 5 * m).reshape(m, 5)
    return k.view("<u8").ravel()


def by_page(h: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """An order of n-grams by page, the pages that occur, and where each starts in that order (and the end)."""
    page = page_of(h, pages)
    order = np.argsort(page, kind="stable")
    names, start = np.unique(page[order], return_index=True)
    return order, names, [*start.tolist(), len(h)]


def packed(h: np.ndarray, n: np.ndarray, pages: int) -> pa.RecordBatch:
    """(page, entries): for each page one value of all keys, five bytes each, and then all counts, four bytes each."""
    order, names, cut = by_page(h, pages)
    keys = key_bytes(key_of(h[order]))
    counts = n[order].astype("<u4")
    values = [keys[x:y].tobytes() + counts[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(values, pa.binary())], names=["page", "entries"])


def unpacked(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and summed counts of a page's entries."""
    keys, counts = [], []
    for v in values:
        m = len(v) // 9
        keys.append(keys_from(v, m))
        counts.append(np.frombuffer(v, "<u4", m, 5 * m))
    name, back = np.unique(np.concatenate(keys), return_inverse=True)
    return name, np.bincount(back, weights=np.concatenate(counts).astype(float)).astype(np.int64)


def packed_pairs(docs: DataFrame, pages: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n in _tallied(batches, pairs=True):
            yield packed(h, n, pages)

    return docs.select("text").mapInArrow(work, "page int, entries binary")


def packed_words(words: DataFrame, pages: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed(batch.column(0).to_numpy().view(np.uint64), np.minimum(batch.column(1).to_numpy(), 2**32 - 1), pages)

    return words.select("h", "n").mapInArrow(work, "page int, entries binary")


def level(count: np.ndarray, least: int) -> np.ndarray:
    """1 + floor(log2(count / least)) of counts of at least `least`."""
    return np.minimum(1 + np.floor(np.log2(np.maximum(count, least) / least)).astype(np.int64), LEVELS)


def positions(h: np.ndarray, k: int, probe: int, bits: np.ndarray | int) -> np.ndarray:
    return (mix(h + np.uint64((k * PROBES + probe + 1) * int(_STEP) & (1 << 64) - 1)) % np.asarray(bits, dtype=np.uint64)).astype(np.int64)


def build_page(h: np.ndarray, levels: np.ndarray, most: int | None = None) -> np.ndarray:
    """The page's bytes: every entry's bits set. Its size follows the entries, unless a caller sets the most bits."""
    entries = int(levels.sum())
    size = max(8, -(-entries * BITS_PER_ENTRY // 8))
    if most is not None:
        size = max(8, min(size, most // 8))
    page = np.zeros(size, np.uint8)
    for k in range(1, int(levels.max(initial=0)) + 1):
        own = h[levels >= k]
        for probe in range(PROBES):
            at = positions(own, k, probe, size * 8)
            np.bitwise_or.at(page, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return page


class CountFilter:
    """Pages of a log-frequency Bloom filter; probe() gives quantised counts."""

    def __init__(self, pages: dict[int, bytes], count: int, least: int):
        self.count, self.least = count, least
        size = np.array([len(pages.get(p, b"")) for p in range(count)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)])[:-1]
        self.bits = size * 8
        self.data = np.frombuffer(b"".join(pages.get(p, b"") for p in range(count)) or b"\0", np.uint8)

    def levels(self, page: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The highest level that each key of a page reaches, 0 where the first is missing."""
        out = np.zeros(len(key), np.int64)
        live = np.flatnonzero(self.bits[page] > 0)
        for k in range(1, LEVELS + 1):
            for probe in range(PROBES):
                if not len(live):
                    break
                at = positions(key[live], k, probe, self.bits[page[live]])
                live = live[(self.data[self.start[page[live]] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0]
            out[live] = k
        return out

    def read(self, h: np.ndarray) -> np.ndarray:
        """Levels of n-grams."""
        return self.levels(page_of(h, self.count), key_of(h))

    def probe(self, h: np.ndarray) -> np.ndarray:
        return middle(self.read(h), self.least)


def middle(levels: np.ndarray, least: int) -> np.ndarray:
    """Counts: the middle of each level, 0 for level 0."""
    return np.where(levels > 0, least * 0.5 * (2.0 ** (levels - 1) + np.maximum(2.0**levels - 1, 2.0 ** (levels - 1))), 0.0)


def least_count(levels: np.ndarray) -> np.ndarray:
    """The least count of each level, 0 for level 0."""
    return np.where(levels > 0, 2.0 ** (levels - 1), 0.0)


def most_count(levels: np.ndarray) -> np.ndarray:
    """The most that each level's count can be."""
    return 2.0**levels - 1


def filter_pages(entries: DataFrame, least: int) -> DataFrame:
    """(page, bytes) of entries (page, entries): every page is counted and built in one task, which holds some PAGE_TOKENS tokens' n-grams."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n = unpacked(pdf["entries"].tolist())
        often = n >= least
        return pd.DataFrame({"page": [pdf["page"].iloc[0]], "bytes": [build_page(key[often], level(n[often], least)).tobytes()]})

    return entries.groupBy("page").applyInPandas(build, "page int, bytes binary")


def collected(pages: DataFrame, count: int, least: int) -> CountFilter:
    built = pages.toArrow()
    return CountFilter(dict(zip(built.column("page").to_pylist(), built.column("bytes").to_pylist(), strict=True)), count, least)


class Sought:
    """The distinct words and pairs of rows of tokens, and the rows' probabilities once their counts are known."""

    def __init__(self, tokens: np.ndarray, at: np.ndarray):
        self.at = at
        before = contexts(tokens, at)
        self.words, self.back = np.unique(tokens, return_inverse=True)
        place = np.minimum(np.searchsorted(self.words, before), max(0, len(self.words) - 1))
        self.place, self.known = place, self.words[place] == before
        self.pairs, self.pair_back = np.unique(pair_hash(before, tokens), return_inverse=True)

    def log10(self, levels: np.ndarray, pair_levels: np.ndarray, size: int) -> np.ndarray:
        """log10 probability of each row by the levels of words and pairs; size: tokens and distinct tokens learned from."""
        cv = np.where(self.known, most_count(levels)[self.place], 0.0)
        low = (least_count(levels)[self.back] + 1) / (size + 1)
        p = (np.minimum(least_count(pair_levels)[self.pair_back], cv) + WEIGHT * low) / (cv + WEIGHT)
        return np.add.reduceat(np.log10(p), self.at[:-1]) if len(self.at) > 1 else np.zeros(0)


class FilterModel:
    """Smoothed pair probabilities from probed counts."""

    def __init__(self, words: CountFilter, pairs: CountFilter, total: int, distinct: int):
        self.words, self.pairs, self.total, self.distinct = words, pairs, total, distinct

    def log10(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each row of tokens."""
        sought = Sought(tokens, at)
        return sought.log10(self.words.read(sought.words), self.pairs.read(sought.pairs), self.total + self.distinct)


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers byte place by byte place, so that high places, nearly all zero, take no room."""
    return pa.compress(np.concatenate([x.astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel() for x in columns]).tobytes(), "zstd", asbytes=True)


def spread(data: bytes, m: int, columns: int) -> list[np.ndarray]:
    """The columns of squeezed(), m numbers each."""
    raw = np.frombuffer(pa.decompress(data, columns * 8 * m, "zstd", asbytes=True), np.uint8).reshape(columns, 8, m)
    return [np.ascontiguousarray(x.T).view("<u8").ravel() for x in raw]


def paged(h: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of ascending n-grams by page, ascending in each, and where each page starts in that order (and the end)."""
    page = page_of(h, pages)
    order = np.argsort(page.astype(np.uint16) if pages <= 1 << 16 else page, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(page, minlength=pages))])


def in_blocks(texts: DataFrame) -> DataFrame:
    """(block, ids, learn, ask, ends, text) of texts (doc_id, text, learn, ask): compressed texts of some SENT_BYTES a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column(1), SENT_BYTES):
                listed = [pa.ListArray.from_arrays(pa.array([0, end - row], pa.int32()), batch.column(k).slice(row, end - row)) for k in (0, 2, 3)]
                held = [pa.array([x], pa.binary()) for x in (offsets.astype(np.int64).tobytes(), pa.compress(data.tobytes(), "zstd", asbytes=True))]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *listed, *held], names=["block", "ids", "learn", "ask", "ends", "text"])
                block += 1

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "learn", "ask").mapInArrow(work, f"block long, ids array<{kind}>, learn array<boolean>, ask array<boolean>, ends binary, text binary")


def block_tokens(ends: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """token_rows() of a whole block."""
    offsets = np.frombuffer(ends, np.int64)
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends), pa.decompress(text, int(offsets[-1]), "zstd"))
    parts = [token_rows(data, own) for _, _, data, own in text_blocks(texts)]
    sizes = np.concatenate([np.diff(at) for _, at in parts])
    return np.concatenate([tokens for tokens, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def sent(blocks: DataFrame, pages: int) -> DataFrame:
    """(block, page, n_words, words, n_pairs, pairs): a block's distinct words (hashes) and pairs (keys) of a page, ascending, by their differences, with their counts in rows to learn from."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, learn, ends, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                tokens, at = block_tokens(ends.as_py(), text.as_py())
                sought = Sought(tokens, at)
                learned = np.repeat(learn.values.to_numpy(zero_copy_only=False).astype(float), np.diff(at))
                kinds = []
                for h, back, named in ((sought.words, sought.back, lambda h: h), (sought.pairs, sought.pair_back, key_of)):
                    order, cut = paged(h, pages)
                    kinds.append((named(h)[order], np.bincount(back, weights=learned, minlength=len(h)).astype(np.int64)[order], cut))
                names = np.flatnonzero(sum(np.diff(cut) for *_, cut in kinds))
                columns = []
                for h, n, cut in kinds:
                    ranges = [(cut[p], cut[p + 1]) for p in names.tolist()]
                    columns += [pa.array([y - x for x, y in ranges], pa.int64()), pa.array([squeezed(np.diff(h[x:y], prepend=np.uint64(0)), n[x:y]) for x, y in ranges], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(names), pa.int64()), pa.array(names.astype(np.int32)), *columns], names=["block", "page", "n_words", "words", "n_pairs", "pairs"])

    return blocks.select("block", "learn", "ends", "text").mapInArrow(work, "block long, page int, n_words long, words binary, n_pairs long, pairs binary")


def answered(asked: DataFrame) -> DataFrame:
    """(block, page, words, pairs, total, distinct) for what was sent(): counts and levels of words, levels of pairs; a page's tokens and distinct tokens stand in one of its rows."""

    def answer(own: pa.Table) -> pa.Table:
        told, stats = [], []
        for kind in ("words", "pairs"):
            m = own.column(f"n_{kind}").to_pylist()
            got = [spread(x.as_py(), k, 2) for x, k in zip(own.column(kind), m, strict=True)]
            name, back = np.unique(np.concatenate([np.cumsum(steps, dtype=np.uint64) for steps, _ in got]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([c for _, c in got]).astype(float), minlength=len(name)).astype(np.int64)
            key, seen = key_of(name) if kind == "words" else name, n > 0
            one = CountFilter({0: build_page(key[seen], level(n[seen], 1)).tobytes()}, 1, 1)
            levels = np.concatenate([np.zeros(0, np.int64)] + [one.levels(np.zeros(len(x), np.int64), x) for x in (key[k : k + PAGE_PROBES] for k in range(0, len(key), PAGE_PROBES))])
            cut = np.cumsum([0, *m]).tolist()
            stats.append((int(n.sum()), int(seen.sum())))
            told.append(pa.array([squeezed(*(c[back[x:y]] for c in ((n, levels) if kind == "words" else (levels,)))) for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))
        first = [pa.array([x] + [0] * (own.num_rows - 1), pa.int64()) for x in stats[0]]
        return pa.table([own.column("block"), own.column("page"), *told, *first], names=["block", "page", "words", "pairs", "total", "distinct"])

    return asked.groupBy("page").applyInArrow(answer, "block long, page int, words binary, pairs binary, total long, distinct long")


def joined_scores(texts: DataFrame, pages: int) -> DataFrame:
    """What score_documents() gives, of the asked rows of texts (doc_id, text, learn, ask), by pages that needn't fit into memory together."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    blocks = materialise(in_blocks(texts))
    answers = materialise(answered(sent(blocks, pages)))
    total, distinct = (x or 0 for x in answers.agg(F.sum("total"), F.sum("distinct")).first())
    share = float(total + distinct + 1)

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        ids, ask = own.column("ids")[0].values, own.column("ask")[0].values
        tokens, at = block_tokens(own.column("ends")[0].as_py(), own.column("text")[0].as_py())
        sought = Sought(tokens, at)
        told = told.sort_by("page")
        names = told.column("page").to_numpy()
        got = []
        for name, h, columns in (("words", sought.words, 2), ("pairs", sought.pairs, 1)):
            order, cut = paged(h, pages)
            out = np.empty((columns, len(h)), np.int64)
            out[:, order] = np.concatenate([spread(x.as_py(), m, columns) for x, m in zip(told.column(name), np.diff(cut)[names].tolist(), strict=True)], axis=1)
            got.append(out)
        (n, levels), (pair_levels,) = got
        c = n[sought.back]
        base = np.add.reduceat(np.log10((c + 1) / share), at[:-1])
        known = np.add.reduceat((c > 0).astype(np.int64), at[:-1])
        found = [ids, pa.array(np.diff(at)), pa.array(known), pa.array(np.full(len(ids), total)), pa.array(base), pa.array(sought.log10(levels, pair_levels, total + distinct))]
        return pa.table(found, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]).filter(ask)

    asking = blocks.select("block", "ids", "ask", "ends", "text")
    return asking.groupBy("block").cogroup(answers.select("block", "page", "words", "pairs").groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, train: DataFrame | Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text), learned from train: rows, or which rows of docs."""
    spark = docs.sparkSession
    within = isinstance(train, Column)
    texts = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("learn") if within else F.lit(False).alias("learn"), F.lit(True).alias("ask"))
    if not within:
        texts = texts.unionByName(train.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.lit(True).alias("learn"), F.lit(False).alias("ask")))
    size, rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    pages = max(8, -(-size // (PAGE_TOKENS * TOKEN_BYTES)))
    # a token takes two bytes at least, or ends a row, and gives two entries at most
    if (size / 2 + rows) * 2 * BITS_PER_ENTRY / 8 > BROADCAST_BYTES:
        return joined_scores(texts, pages)
    train = docs.where(train) if within else train
    words = materialise(word_counts(train))
    total, distinct = (x or 0 for x in words.agg(F.sum("n"), F.count("*")).first())
    model = FilterModel(*(collected(filter_pages(x, 1), pages, 1) for x in (packed_words(words, pages), packed_pairs(train, pages))), total, distinct)
    often = max(1, total // HEAD)
    head = words.where(F.col("n") >= often).toArrow()
    order = np.argsort(head.column("h").to_numpy().view(np.uint64))
    head_h, head_n = head.column("h").to_numpy().view(np.uint64)[order], head.column("n").to_numpy()[order]
    shared = spark.sparkContext.broadcast((model, head_h, head_n))
    share = float(total + distinct + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head_h, head_n = shared.value
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column(1)):
                tokens, at = token_rows(data, offsets)
                rows = end - row
                of = np.repeat(np.arange(rows), np.diff(at))
                place = np.minimum(np.searchsorted(head_h, tokens), max(0, len(head_h) - 1))
                known = head_h[place] == tokens if len(head_h) else np.zeros(len(tokens), bool)
                c = np.where(known, head_n[place] if len(head_h) else 0, 0)
                base = np.bincount(of, weights=np.where(known, np.log10((c + 1) / share), 0.0), minlength=rows)
                n_known = np.bincount(of, weights=known, minlength=rows).astype(np.int64)
                rare, rare_of = tokens[~known], of[~known]
                cut = np.searchsorted(rare_of, np.arange(rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(rare.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(serial, serial + rows)), batch.column(0).slice(row, rows), pa.array(np.diff(at)), pa.array(n_known), pa.array(base), lists, pa.array(model.log10(tokens, at))],
                    names=["row", "doc_id", "n_tokens", "head_known", "head_base", "rare", "score"],
                )
                serial += rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialise(docs.select("doc_id", "text").mapInArrow(work, f"row long, doc_id {kind}, n_tokens long, head_known long, head_base double, rare array<long>, score double"))
    rare = rows.select("row", F.explode("rare").alias("h"))
    tail = rare.join(words.where(F.col("n") < often), "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = tail.groupBy("row").agg(F.sum(F.log10((F.col("n") + 1) / F.lit(share))).alias("base"), F.count_if(F.col("n") > 0).alias("known"))
    return rows.drop("rare").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("head_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score"
    )


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = crc_class(F.col("doc_id"), MODULUS)
    out = score_documents(docs, (part != HELD_OUT) & (part >= 0))
    return out.select("doc_id", (part == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
