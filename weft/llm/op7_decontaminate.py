"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

Texts are lower-cased (A-Z) and cut into words of digits, a-z and characters beyond ASCII. The automaton of the items is
built on the driver, packed into arrays and broadcast; every document's words are streamed through it, which gives at
each word the longest match that ends there. A match of at least `window` words ends an occurrence of a window; an item
of fewer words is one window as a whole. Stretches of words in which some word, or some pair of neighbours, is in no item
can't hold a window and are passed over before the automaton (found for a whole block at once).

The items are a stated query set. They are dealt into blocks of ITEM_CHARS by item, so that the driver builds one bounded
automaton at a time (some 750 bytes a word while it is built, some 60 when packed), and documents pass as many packed
blocks at once as take PASS_BYTES; further passes are written to shared storage one after another.

Nulls have no words; an empty benchmark hits nothing; an empty table gives no rows. Items without id or words take no
part; rows of one item_id are one item with several texts. Repeated documents each get their row; further columns are
kept, whatever their names, but for those named as the result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import _LOWER, fresh_name, materialise, slices, table, text_blocks, word_places

#: Characters of the items in one automaton, about, and bytes of packed automata in one pass over the documents.
ITEM_CHARS, PASS_BYTES = 2_000_000, 1 << 26
WINDOW = 10

_GAP = np.ones(256, dtype=bool)
_GAP[48:58] = _GAP[97:123] = _GAP[128:] = False


def hashed_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return word_places(data, np.array([0, len(data)]), _LOWER, _GAP)[0]


class Growing:
    """The automaton while it is built: a dict of arcs for each state, suffix links and lengths."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, codes: list[int]) -> None:
        last = 0
        for x in codes:
            last = self._extend(last, x)

    def _extend(self, last: int, x: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if x in nxt[last]:
            q = nxt[last][x]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, x, q)
        cur = len(link)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and x not in nxt[p]:
            nxt[p][x] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][x]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, x, q)
        return cur

    def _clone(self, p: int, x: int, q: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = new
            p = self.link[p]
        return new


class ItemAutomaton:
    """Generalised suffix automaton of word sequences as arrays, with the windows and short items that end at its states."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window = window
        words = [(i, w) for i, w in items if len(w)]
        self.vocabulary = np.unique(np.concatenate([w for _, w in words])) if words else np.zeros(0, np.uint64)
        v = self.size = max(1, len(self.vocabulary))
        coded = [(i, np.searchsorted(self.vocabulary, w).tolist()) for i, w in words]
        pairs = [np.asarray(c[:-1], np.int64) * v + np.asarray(c[1:], np.int64) for _, c in coded if len(c) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.shortest = min([window, *(len(c) for _, c in coded)])
        growing = Growing()
        for _, c in coded:
            growing.add(c)
        arcs = np.array([(s * v + x, t) for s, own in enumerate(growing.next) for x, t in own.items()], np.int64).reshape(-1, 2)
        arcs = arcs[np.argsort(arcs[:, 0])]
        #: arcs by state * words + word, and where they lead
        self.keys, self.to = np.ascontiguousarray(arcs[:, 0]), arcs[:, 1].astype(np.int32)
        self.link, self.len = np.array(growing.link, np.int32), np.array(growing.len, np.int32)
        self.items = sorted({i for i, _ in words})
        number = {i: k for k, i in enumerate(self.items)}
        ends, self.short = [], {}
        for i, c in coded:
            at = 0
            for k, x in enumerate(c, 1):
                at = growing.next[at][x]
                if k >= window:
                    ends.append((self._window_state(growing.link, growing.len, at), number[i]))
            if len(c) < window:
                self.short.setdefault(at, set()).add((len(c), number[i]))
        ends = np.unique(np.array(ends, np.int64).reshape(-1, 2), axis=0)
        #: items of windows, one after another by state
        self.window_states, start = np.unique(ends[:, 0], return_index=True)
        self.window_cuts, self.window_items = np.append(start, len(ends)), ends[:, 1].astype(np.int32)
        #: the nearest state on the way of suffix links, itself first, where short items end; 0 for none
        self.short_at = np.zeros(len(self.link), np.int32)
        if self.short:
            for s in np.argsort(self.len, kind="stable").tolist()[1:]:
                self.short_at[s] = s if s in self.short else self.short_at[self.link[s]]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def _window_state(self, link, length, state: int) -> int:
        """The state of the last `window` words of what is matched."""
        while length[link[state]] >= self.window:
            state = link[state]
        return state

    def stream(self, codes: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, end, numbers of items) of each occurrence of a window in a stretch of known words."""
        keys, to, link, length = (memoryview(x) for x in (self.keys, self.to, self.link, self.len))
        states, cuts, v, n = memoryview(self.window_states), self.window_cuts, self.size, len(self.keys)
        state = matched = 0
        for k, x in enumerate(codes, 1):
            while True:
                key = state * v + x
                at = bisect_left(keys, key)
                if at < n and keys[at] == key:
                    state, matched = to[at], matched + 1
                    break
                if not state:
                    break
                state = link[state]
                matched = length[state]
            if matched >= self.window:
                own = self._window_state(link, length, state)
                at = bisect_left(states, own)
                if at < len(states) and states[at] == own:
                    yield k - self.window, k, self.window_items[cuts[at] : cuts[at + 1]].tolist()
            s = int(self.short_at[state])
            while s > 0:
                for size, item in self.short[s]:
                    if size <= matched:
                        yield k - size, k, [item]
                s = int(self.short_at[link[s]])

    def block(self, hashes: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, list[int]]]]:
        """Occurrences by row of a block of texts; words count from the row's first."""
        out: dict[int, list] = {}
        if not len(hashes) or not len(self.vocabulary):
            return out
        code = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[code] == hashes
        tied = known[:-1] & known[1:]
        tied[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(hashes))] - 1] = False
        at = np.flatnonzero(tied)
        if len(at) and len(self.pairs):
            pair = code[at].astype(np.int64) * max(1, len(self.vocabulary)) + code[at + 1]
            tied[at] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        else:
            tied[:] = False
        # stretches of known words that are tied pair by pair
        head, tail = known.copy(), known.copy()
        head[1:] &= ~tied
        tail[:-1] &= ~tied
        start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        keep = end - start >= self.shortest
        start, end = start[keep], end[keep]
        rows = np.searchsorted(first, start, side="right") - 1
        for row, a, b in zip(rows.tolist(), start.tolist(), end.tolist(), strict=True):
            for x, y, found in self.stream(code[a:b].tolist()):
                base = a - int(first[row])
                out.setdefault(row, []).append((base + x, base + y, found))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _automata(benchmark: DataFrame, window: int, item_chars: int, pass_bytes: int) -> Iterator[list[ItemAutomaton]]:
    """Automata of the items, as many at a time as one pass takes; the driver holds one block's items at a time."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // item_chars))
    held: list[ItemAutomaton] = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        own = ItemAutomaton([(r.item, hashed_words(r.text)) for r in part.toLocalIterator()], window)
        if held and sum(x.nbytes() for x in [*held, own]) > pass_bytes:
            yield held
            held = []
        held.append(own)
    yield held


_SPANS = "array<struct<first:long,end:long,byte_start:long,byte_end:long>>"


def _passed(df: DataFrame, benchmark: DataFrame, window: int, item_chars: int, pass_bytes: int, names: tuple[str, str, str], finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, columns: list[str] | None = None) -> DataFrame:
    """df with three more columns: number of words, merged spans, items; or what `finish` makes of that, with `columns`."""
    spark, text_at, width = df.sparkSession, df.columns.index("text"), len(df.columns)
    base = df.withColumns({names[0]: F.lit(None).cast("long"), names[1]: F.expr(f"cast(array() as {_SPANS})"), names[2]: F.expr("cast(array() as array<string>)")})
    schema = base.schema
    passes = iter(_automata(benchmark, window, item_chars, pass_bytes))
    automata = next(passes)
    while automata:
        following = next(passes, None)
        shared = spark.sparkContext.broadcast(automata)
        last = finish if following is None else None

        def work(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                counts, spans, items = [], batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist()
                for row, end, data, offsets in text_blocks(batch.column(text_at)):
                    h, first, s, e = word_places(data, offsets, _LOWER, _GAP)
                    counts += np.diff(first).tolist()
                    for auto in shared.value:
                        for at, found in auto.block(h, first).items():
                            old = [(x["first"], x["end"]) for x in spans[row + at]]
                            f, o = int(first[at]), int(offsets[at])
                            spans[row + at] = [{"first": a, "end": b, "byte_start": int(s[f + a]) - o, "byte_end": int(e[f + b - 1]) - o} for a, b in merged(old + [x[:2] for x in found])]
                            items[row + at] = sorted({*items[row + at], *(auto.items[i] for i in {i for x in found for i in x[2]})})
                out = [*batch.columns[:width], pa.array(counts, pa.int64()), pa.array(spans, batch.schema.field(width + 1).type), pa.array(items, batch.schema.field(width + 2).type)]
                made = pa.RecordBatch.from_arrays(out, names=schema.names)
                yield last(made) if last else made

        base = base.mapInArrow(work, df.select(*columns).schema if last else schema)
        if following is not None:
            base = materialise(base)
        automata = following
    return base


def find_items(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_chars: int = ITEM_CHARS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """df with n_words, spans (merged occurrences: words from `first` to before `end`, and their bytes) and items; columns of these names give way."""
    return _passed(df.drop("n_words", "spans", "items"), benchmark, window, item_chars, pass_bytes, ("n_words", "spans", "items"))


def clean_documents(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, longest: int = 0, coverage: float = 0.5, item_chars: int = ITEM_CHARS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """df without contamination: spans of more than `longest` words are cut from texts, and rows go of whose words more than `coverage` are in spans."""
    width, text_at = len(df.columns), df.columns.index("text")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        stay, texts = [], batch.column(text_at)
        counts, spans = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
        if any(spans):
            texts = texts.to_pylist()
            for k, own in enumerate(spans):
                if not own:
                    stay.append(k)
                    continue
                if sum(x["end"] - x["first"] for x in own) <= counts[k] * coverage:
                    stay.append(k)
                    raw, at, parts = texts[k].encode(), 0, []
                    for x in own:
                        if x["end"] - x["first"] > longest:
                            parts.append(raw[at : x["byte_start"]])
                            at = x["byte_end"]
                    texts[k] = b"".join([*parts, raw[at:]]).decode()
            texts = pa.array(texts, pa.string())
            columns = [*batch.columns[:text_at], texts, *batch.columns[text_at + 1 : width]]
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width]).take(pa.array(stay, pa.int64()))
        return pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width])

    names = tuple(fresh_name(df, x) for x in ("n_words", "spans", "items"))
    return _passed(df, benchmark, window, item_chars, pass_bytes, names, finish, df.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item,
         list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS win
  FROM i, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS u(k) WHERE len(ws) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, k, n, array_to_string(ws[k:k + n - 1], ' ') AS win
  FROM w, ns, unnest(range(1, len(ws) - n + 2)) AS u(k) WHERE len(ws) >= n),
m AS (SELECT r, k, dw.n AS n, item FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM m, unnest(range(k, k + n)) AS u(p) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
