"""Exact Jaccard self-join on word shingles by universe partition and pigeonhole, and the components of its links.

Texts are lower-cased (A-Z) and cut at white space; a document's set has its distinct 5-word shingles as 64-bit
hashes, or its whole word sequence as one where it is shorter. Documents with equal sets are one node from the start
(named by a 64-bit hash of the set), so that groups of exact copies cost nothing beyond their map task.

Size bands: a set links only with sets of its own band or the next, and each scheme (band) bounds the symmetric
difference of such pairs by H = (|a|+|b|)/9. The scheme's hash deals the universe of shingles into U = H+1+z units.
Units alone make exact segments (threshold 0); two units together make a segment with its one-deletion neighbourhood
(threshold 1). A pair of a link can break H units at most, so z+1 units stay whole and give the pair a common
signature, unless they have too little in them: an empty segment gives no signature. A set in which more than z units
are that weak is also dealt by the next of LEVELS hashes, at last into one bucket of such sets of its scheme, so that
no link is lost whatever the hashes do. How many segments get deletion neighbourhoods is chosen for each scheme by
cost: signatures made against candidates expected, from the number of sets in the band.

Signatures: a first pass over the texts sends five bytes of each to its page, once for each task, and a page keeps those
that were seen twice; a second pass gives (signature, node) of these live ones alone. They are broadcast while they
take BROADCAST_BYTES at most, and joined beyond that.

Only one row of each set is signed as long as a bitmap of the chosen rows tells them apart.

Candidates: in the bucket of a signature every member is paired with the smallest (a star, not all pairs); sizes and
a 512-bit parity sketch (which can't differ in more bits than the sets differ in shingles) throw out most pairs that are
no links, and the rest is verified on the texts' whole sets. Then only buckets that still hold several components count.
Of them, those of more than HOT members (a passage that many texts hold) are left out for a set that has fewer of them
than signatures it must share with any partner (z+1 less its empty segments), since such a pair meets elsewhere. All
others are dealt into chunks of CHUNK members, and a task compares two chunks: of each member it gives the list of those in other components
that sizes and sketches allow. Lists are checked block by block, first by sketches of 4,096 bits, a list's row carrying
its own, and then by whole texts; a member that has met a link to a component isn't compared with the rest of it. So rows
grow with members and blocks, not with pairs, and blocks that many members ask for are copied for groups of them.

Rows without words or text link with nothing (n_shingles 0), rows with a null doc_id neither (component null).
Repeated rows of a doc_id each get their row. Very long texts are a block of their own. An empty table gives no rows.
Further columns take no part; without_copies() keeps them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import fresh_name, materialise, mix, table, text_blocks, word_hashes
from weft.llm.components import Bitmap, spread_labels

WIDTH = 5
#: Similarity in hundredths.
LEAST = 80
LEVELS = 3
#: Shares in the cost model: of shingles that many documents have in common, and of sets of a band that share them.
COMMON_SHARE, COMMON_SETS = 0.3, 0.0005
SKETCH = 8
#: Signatures of a page, about, and how many a task gathers before it sends them.
PAGE_SIGNATURES, FLUSH = 1_500_000, 2_000_000
#: Live signatures are broadcast up to this size.
BROADCAST_BYTES = 1 << 26
#: Members beyond which a bucket is left to those sets that can't do without it.
HOT = 24
#: Members of a bucket that a task compares with another chunk, and characters of the texts of a block.
CHUNK, BLOCK_CHARS = 4_000, 1 << 20
#: Bits of the sketch that long lists are checked by first, and nodes of a block then.
WIDE, BLOCK_NODES = 4_096, 2_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row of a block, one after another, and the rows' offsets."""
    h, first = word_hashes(data, offsets)
    counts = np.diff(first)
    rows = len(counts)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    total = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        total = total * _STEP + h[k : k + len(total)]
    row_of = np.repeat(np.arange(rows), counts)
    fits = np.arange(len(total)) + width <= first[1:][row_of[: len(total)]]
    out, at = mix(total[fits]), np.concatenate([[0], np.cumsum(np.where(counts >= width, counts - width + 1, 0))])
    few = np.flatnonzero((counts > 0) & (counts < width))
    parts, sizes = [], np.zeros(rows, np.int64)
    short = set(few.tolist())
    for r in range(rows):
        if r in short:
            x = np.uint64(counts[r])
            with np.errstate(over="ignore"):
                for w in h[first[r] : first[r + 1]]:
                    x = x * _STEP + w
            part = mix(np.array([x ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))
        else:
            part = np.sort(out[at[r] : at[r + 1]])
            if len(part) > 1:
                keep = np.empty(len(part), dtype=bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                part = part[keep]
        parts.append(part)
        sizes[r] = len(part)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def set_names(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles + _STEP))])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def sketches(shingles: np.ndarray, at: np.ndarray, bits: int = 512) -> np.ndarray:
    """Parity bits of each row's set, as longs."""
    rows = len(at) - 1
    row_of = np.repeat(np.arange(rows), np.diff(at))
    bit = (shingles >> np.uint64(7)).astype(np.int64) & (bits - 1)
    odd = (np.bincount(row_of * bits + bit, minlength=rows * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, bits), axis=1, bitorder="little").view(np.int64)


class Scheme(NamedTuple):
    band: int
    smallest: int
    bound: int
    units: int
    pairs: int  # segments of two units with deletion neighbourhoods
    slack: int

    @property
    def segments(self) -> int:
        return self.units - self.pairs


def bands(largest: int, least: int = LEAST) -> list[int]:
    """First sizes of the bands: a set of the last size before a band reaches no further than that band."""
    out = [1, 2]
    while out[-1] <= largest:
        out.append((out[-1] - 1) * 100 // least + 1 if (out[-1] - 1) * 100 // least + 1 > out[-1] else out[-1] + 1)
    return [*out, (out[-1] - 1) * 100 // least + 1]


def plan(band: int, low: int, high: int, sets: int, least: int = LEAST) -> Scheme | None:
    """The cheapest scheme for sets of low to high shingles and their partners; None where only equal sets link."""
    bound = (high + high * 100 // least) * (100 - least) // (100 + least)
    if not bound:
        return None
    best = None
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        for slack in range(bound + 8):
            units = bound + 1 + slack
            pairs = min(units // 2, math.ceil(share * units / 2))
            single = units - 2 * pairs
            rate = low / units
            p0 = math.exp(-rate)
            p1 = 0.0 if pairs == 1 and not single else math.exp(-2 * rate) * (1 + 2 * rate)
            weak = single * p0 + 2 * pairs * p1
            if slack + 0.5 >= weak + 1.6 * math.sqrt(single * p0 * (1 - p0) + 4 * pairs * p1 * (1 - p1)):
                break
        else:
            continue
        own = rate * (1 - COMMON_SHARE)
        shared = single * (math.exp(-own) - p0) + pairs * max(0.0, math.exp(-2 * own) * (1 + 2 * own) - p1)
        cost = single * (1 - p0) + pairs * (1 + 2 * rate) + COMMON_SETS * sets * shared
        if best is None or cost < best[0]:
            best = cost, Scheme(band, low, bound, units, pairs, slack)
    return best[1] if best else Scheme(band, low, bound, bound + 1, (bound + 1) // 2, 0)


def signatures(shingles: np.ndarray, at: np.ndarray, schemes: dict[int, Scheme], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, tag) of the rows' sets, by their own band's scheme (0) and that of the band below (1).

    The tag is 2 * (how many of the scheme's signatures any partner shares at least, 0 if that isn't known) + the scheme.
    """
    size = np.diff(at)
    band = np.searchsorted(edges, size, side="right") - 1
    out_sig, out_row, out_tag = [], [], []
    for below in (0, 1):
        rows = np.array([r for r in np.flatnonzero(size > 0).tolist() if int(band[r]) - below in schemes], np.int64)
        for level in range(LEVELS):
            if not len(rows):
                break
            own = [schemes[int(band[r]) - below] for r in rows.tolist()]
            units, pairs, slack, scheme = (np.array([getattr(s, k) for s in own], np.int64) for k in ("units", "pairs", "slack", "band"))
            n = size[rows]
            item = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows.tolist()])
            row = np.repeat(np.arange(len(rows)), n)
            h = shingles[item]
            dealt = mix(h + np.array([level + 1], np.uint64) * _STEP)
            unit = (((dealt >> np.uint64(40)) * units[row].astype(np.uint64)) >> np.uint64(24)).astype(np.int64)
            x = pairs[row]
            segment = np.where(unit < 2 * x, unit >> 1, unit - x)
            base = np.concatenate([[0], np.cumsum(units - pairs)])
            cell = base[row] + segment
            cells = int(base[-1])
            value = mix(dealt + _STEP)
            total = np.bincount(cell, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=cells).astype(np.uint64) + (np.bincount(cell, weights=(value >> np.uint64(32)).astype(np.float64), minlength=cells).astype(np.uint64) << np.uint64(32))
            held = np.bincount(cell, minlength=cells)
            cell_row = np.repeat(np.arange(len(rows)), units - pairs)
            place = np.arange(cells) - base[cell_row]
            deleting = place < pairs[cell_row]
            name = mix((scheme[cell_row].astype(np.uint64) << np.uint64(40)) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(level))
            weak = np.bincount(cell_row, weights=np.where(deleting, 2 * (held <= 1), held == 0), minlength=len(rows)).astype(np.int64)
            sure = np.where((pairs == 0) & (level == 0), np.maximum(slack + 1 - weak, 0), 0) * 2 + below
            full = held > 0
            out_sig.append(mix(total[full] + name[full]))
            out_row.append(rows[cell_row[full]])
            out_tag.append(sure[cell_row[full]])
            cut = deleting[cell] & (held[cell] > 1)
            if cut.any():
                out_sig.append(mix(total[cell[cut]] - value[cut] + name[cell[cut]]))
                out_row.append(rows[row[cut]])
                out_tag.append(sure[row[cut]])
            rows = rows[weak > slack]
            band_of = scheme[weak > slack]
        if len(rows):
            out_sig.append(mix((band_of.astype(np.uint64) << np.uint64(40)) + np.uint64(0xFF)))
            out_row.append(rows)
            out_tag.append(np.full(len(rows), below))
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_row), np.concatenate(out_tag)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, node and sketch of each row; node is null without shingles."""
    names = [f"s{k}" for k in range(SKETCH)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column(1)):
                shingles, at = shingle_sets(data, offsets)
                bits, n = sketches(shingles, at), np.diff(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(n), pa.array(set_names(shingles, at), mask=n == 0), *(pa.array(bits[:, k].copy()) for k in range(SKETCH))], names=["doc_id", "n", "node", *names])

    return docs.mapInArrow(work, "doc_id long, n long, node long, " + ", ".join(f"{k} long" for k in names))


def _named(df: DataFrame, name: str) -> DataFrame:
    """df with the names of its rows' sets (null without shingles)."""
    at = df.columns.index("text")
    schema = df.withColumn(name, F.lit(None).cast("long")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column(at)):
                shingles, ends = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in batch.columns), pa.array(set_names(shingles, ends), mask=np.diff(ends) == 0)], names=schema.names)

    return df.mapInArrow(work, schema)


def _signing(batches: Iterator[pa.RecordBatch], chosen: Bitmap, schemes: dict[int, Scheme], first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(signatures, nodes, tags) of the sets of the chosen rows of (text, place); a set that a task meets again is mostly passed over."""
    met: set[int] = set()
    for batch in batches:
        batch = batch.filter(pa.array(chosen.mask(batch.column(1).to_numpy())))
        for _, _, data, offsets in text_blocks(batch.column(0)):
            shingles, at = shingle_sets(data, offsets)
            names = set_names(shingles, at)
            size = np.diff(at)
            fresh = np.zeros(len(names), dtype=bool)
            for k, x in enumerate(names.tolist()):
                if x not in met:
                    met.add(x)
                    fresh[k] = True
            if len(met) > 50_000:
                met.clear()
            if not fresh.all():
                shingles = shingles[np.repeat(fresh, size)]
                names, size = names[fresh], size[fresh]
                at = np.concatenate([[0], np.cumsum(size)])
            sig, row, tag = signatures(shingles, at, schemes, first)
            yield sig, names[row], tag


def codes(sig: np.ndarray, pages: int) -> np.ndarray:
    """Page (the high bits) and five bytes of each signature: what pages know it by. Two signatures may share a code."""
    return (((sig >> np.uint64(40)) % np.uint64(pages)) << np.uint64(40)) | (sig & np.uint64((1 << 40) - 1))


def _live(docs: DataFrame, chosen: Bitmap, schemes: dict[int, Scheme], first: np.ndarray, pages: int) -> DataFrame:
    """(codes, n): of each page the sorted codes that two sets may share, eight bytes each, and their number."""

    def tell(found: list[np.ndarray]) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(found), return_counts=True)
        page = (code >> np.uint64(40)).astype(np.int64)
        names, start = np.unique(page, return_index=True)
        raw = np.ascontiguousarray(code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        once, twice = [], []
        for x, y in zip(start.tolist(), [*start.tolist()[1:], len(code)], strict=True):
            lone = n[x:y] == 1
            once.append(raw[x:y][lone].tobytes())
            twice.append(raw[x:y][~lone].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["page", "once", "twice"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for sig, _, _ in _signing(batches, chosen, schemes, first):
            held.append(codes(sig, pages))
            size += len(sig)
            if size > FLUSH:
                yield tell(held)
                held, size = [], 0
        if size:
            yield tell(held)

    def keys(values: pd.Series) -> np.ndarray:
        raw = np.frombuffer(b"".join(values), np.uint8).reshape(-1, 5)
        out = np.zeros((len(raw), 8), np.uint8)
        out[:, :5] = raw
        return out.view("<u8").ravel()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        once, n = np.unique(keys(pdf["once"]), return_counts=True)
        live = np.union1d(once[n > 1], keys(pdf["twice"]))
        # a key of one task's `once` may be another's `twice`; the union has it
        live = live | (np.uint64(pdf["page"].iloc[0]) << np.uint64(40))
        return pd.DataFrame({"codes": [live.tobytes()], "n": [len(live)]})

    sent = _placed(docs, chosen).mapInArrow(work, "page int, once binary, twice binary")
    return sent.groupBy("page").applyInPandas(build, "codes binary, n long")


def _placed(docs: DataFrame, chosen: Bitmap) -> DataFrame:
    return docs.select("text", chosen.place("doc_id").alias("at"))


def _members(docs: DataFrame, chosen: Bitmap, schemes: dict[int, Scheme], edges: list[int], expected: int, broadcast_bytes: int) -> DataFrame:
    """(sig, node, tag) of the signatures that two nodes may share. Some rows may repeat."""
    first = np.array(edges, np.int64)
    pages = min(1 << 20, max(12, -(-expected // PAGE_SIGNATURES)))
    live = materialise(_live(docs, chosen, schemes, first, pages))
    total = live.agg(F.sum("n")).first()[0] or 0
    small = total * 8 <= broadcast_bytes
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(bytes(r.codes) for r in live.select("codes").toLocalIterator()), np.uint64)) if small else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if small:
            # most codes miss this table of 2^23 flags and needn't be looked for
            maybe = np.zeros(1 << 23, dtype=bool)
            maybe[(mix(known) >> np.uint64(41)).astype(np.int64)] = True
        for sig, node, tag in _signing(batches, chosen, schemes, first):
            code = codes(sig, pages)
            if small:
                at = np.flatnonzero(maybe[(mix(code) >> np.uint64(41)).astype(np.int64)])
                at = at[known[np.minimum(np.searchsorted(known, code[at]), max(0, len(known) - 1))] == code[at]] if len(known) else at[:0]
                sig, node, tag, code = sig[at], node[at], tag[at], code[at]
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node), pa.array(tag.astype(np.int32)), pa.array(code.view(np.int64))], names=["sig", "node", "tag", "code"])

    signed = _placed(docs, chosen).mapInArrow(work, "sig long, node long, tag int, code long")
    if small:
        return signed.drop("code")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64))], names=["code"])

    return signed.join(live.select("codes").mapInArrow(spread, "code long"), "code", "left_semi").drop("code")


def _near(a: str, b: str) -> Column:
    """Whether sizes and sketches of two nodes allow a link."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    bits = sum((F.bit_count(F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * LEAST) & (bits * (100 + LEAST) <= (n + m) * (100 - LEAST))


def _as(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def may_link(n: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches of rows i and j allow a link."""
    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    out = low * 100 >= high * LEAST
    at = np.flatnonzero(out)
    bits = np.bitwise_count((sketch[i[at]] ^ sketch[j[at]]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    out[at] = bits * (100 + LEAST) <= (low[at] + high[at]) * (100 - LEAST)
    return out


def near_rows(n: np.ndarray, sketch: np.ndarray, label: np.ndarray, side: np.ndarray, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of different labels whose sizes and sketches allow a link.

    side: 0 and 1 are two chunks, and only rows of different ones are paired; where there is one chunk, all pairs count.
    """
    left = np.flatnonzero(side == 0) if (side == 1).any() else np.arange(len(n))
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(left), step):
        own = left[k : k + step]
        good = label[own][:, None] != label[right][None, :]
        if left is right:
            good &= own[:, None] < right[None, :]
        x, y = np.nonzero(good)
        x, y = own[x], right[y]
        keep = may_link(n, sketch, x, y)
        i.append(x[keep])
        j.append(y[keep])
    return np.concatenate(i), np.concatenate(j)


def near_in_runs(run: np.ndarray, n: np.ndarray, sketch: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """near_rows() of many small runs of rows at once: pairs of rows of the same run."""
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, len(run)):
        x = np.flatnonzero(run[k:] == run[:-k])
        if not len(x):
            break
        x = x[label[x] != label[x + k]]
        x = x[may_link(n, sketch, x, x + k)]
        i.append(x)
        j.append(x + k)
    return np.concatenate(i), np.concatenate(j)


def _asks(mixed: DataFrame, nodes: DataFrame, chunk: int) -> DataFrame:
    """(node, others) of mixed buckets' members (sig, node, label, m): `others` (y, g) are nodes of other components g that may link."""
    names = [f"s{k}" for k in range(SKETCH)]
    parts = F.ceil(F.col("m") / F.lit(chunk)).cast("int")
    dealt = mixed.withColumns({"of": parts, "own": F.pmod(F.xxhash64("node"), parts).cast("int")})
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    dealt = dealt.select("sig", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), F.when((F.col("own") == F.col("with")) | (F.col("own") < F.col("with")), 0).otherwise(1).alias("side"), "node", "label")
    rows = dealt.join(nodes.select("node", "n", *names), "node").repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high", "node")

    def listed(node: np.ndarray, label: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        who, start = np.unique(x, return_index=True)
        cut = pa.array(np.append(start, len(x)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(node[who]), pa.ListArray.from_arrays(cut, pa.array(node[y])), pa.ListArray.from_arrays(cut, pa.array(label[y]))], names=["node", "ys", "gs"])

    def arrays(t: pa.Table) -> tuple[np.ndarray, ...]:
        return (*(t.column(k).to_numpy() for k in ("node", "label", "n", "side")), np.column_stack([t.column(k).to_numpy() for k in names]))

    def large(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """One bucket, or two chunks of one."""
        node, label, n, side, sketch = arrays(t)
        node, at = np.unique(node, return_index=True)
        label, n, side, sketch = label[at], n[at], side[at], sketch[at]
        i, j = near_rows(n, sketch, label, side)
        if len(i):
            # the member of the component with fewer members here asks
            _, back, count = np.unique(label, return_inverse=True, return_counts=True)
            turn = count[back[i]] > count[back[j]]
            yield listed(node, label, np.where(turn, j, i), np.where(turn, i, j))

    def small(t: pa.Table, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, label, n, _, sketch = arrays(t)
        i, j = near_in_runs(run, n, sketch, label)
        if len(i):
            yield listed(node, label, i, j)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            key = np.column_stack([t.column(k).to_numpy() for k in ("sig", "low", "high")])
            run = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
            # the last run may go on in the next batch
            last = int(np.searchsorted(run, run[-1]))
            size = np.bincount(run[:last]) if last else np.zeros(0, np.int64)
            few = size[run[:last]] <= 32
            if few.any():
                yield from small(t.slice(0, last).filter(pa.array(few)), run[:last][few])
            start = np.concatenate([[0], np.cumsum(size)])
            for k in np.flatnonzero(size > 32).tolist():
                yield from large(t.slice(int(start[k]), int(size[k])))
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield from large(held)

    told = rows.mapInArrow(work, "node long, ys array<long>, gs array<long>")
    both = F.arrays_zip(F.col("ys").alias("y"), F.col("gs").alias("g"))
    return told.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list(both))).alias("others"))


def _told(docs: DataFrame, wanted: DataFrame, wide: bool) -> DataFrame:
    """(node, what, size) of wanted nodes (node, rep), and of some others: wide sketches, or texts."""
    bitmap = Bitmap.of(wanted, "rep")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bitmap.mask(batch.column(1).to_numpy())))
            for row, end, data, offsets in text_blocks(batch.column(0)):
                shingles, at = shingle_sets(data, offsets)
                what = pa.array([x.tobytes() for x in sketches(shingles, at, WIDE)], pa.binary()) if wide else batch.column(0).slice(row, end - row).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(set_names(shingles, at)), what, pa.array(np.diff(at) if wide else np.diff(offsets))], names=["node", "what", "size"])

    return docs.select("text", bitmap.place("doc_id").alias("at")).mapInArrow(work, "node long, what binary, size long")


def _checked(asks: DataFrame, docs: DataFrame, nodes: DataFrame, wide: bool, block_chars: int) -> DataFrame:
    """asks less what can't link: by wide sketches all `others` that they allow, by texts one link to each component of `others`."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = batch.column(1).flatten().field(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([batch.column(0).to_numpy(), ys])))], names=["node"])

    wanted = materialise(asks.mapInArrow(named, "node long").distinct().join(nodes.select("node", "rep"), "node"))
    told = materialise(_told(docs, wanted, wide))
    count, total = told.agg(F.count("*"), F.sum("size")).first()
    blocks = max(8, -(-count // BLOCK_NODES) if wide else -(-(total or 0) // block_chars))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = batch.column(0).to_numpy()
            lists = batch.column(1)
            y, g = (lists.flatten().field(k).to_numpy() for k in (0, 1))
            row = np.repeat(np.arange(len(who)), np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((y % blocks, row))
            y, g, row = y[order], g[order], row[order]
            block = y % blocks
            start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])) if len(y) else np.zeros(0, np.int64)
            cut = pa.array(np.append(start, len(y)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(block[start]), pa.array(who[row[start]]), pa.ListArray.from_arrays(cut, pa.array(y)), pa.ListArray.from_arrays(cut, pa.array(g))], names=["block", "node", "ys", "gs"])

    dealt = asks.mapInArrow(deal, "block long, node long, ys array<long>, gs array<long>").join(told, "node")
    # a block that much asks for is copied
    most = F.lit(4 * BLOCK_NODES) if wide else F.lit(4 * block_chars)
    salts = materialise(dealt.groupBy("block").agg(F.greatest(F.lit(1), F.ceil((F.count("*") if wide else F.sum("size")) / most)).cast("int").alias("salts")))
    asking = dealt.join(salts, "block").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.col("salts")).cast("int")).select("block", "salt", "node", "what", "size", "ys", "gs")
    asked = told.withColumn("block", F.pmod("node", F.lit(blocks))).join(salts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(*(F.col(c).alias(f"y_{c}") for c in ("block", "salt", "node", "what", "size")))

    def by_sketch(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[int, list, list]]:
        place = {x: k for k, x in enumerate(right["y_node"])}
        sketch = np.frombuffer(b"".join(right["y_what"]), np.uint64).reshape(len(right), -1)
        sizes = right["y_size"].to_numpy()
        for x, what, n, ys, gs in zip(left["node"], left["what"], left["size"], left["ys"], left["gs"], strict=True):
            at = np.array([place[y] for y in ys.tolist()])
            bits = np.bitwise_count(sketch[at] ^ np.frombuffer(what, np.uint64)).sum(axis=1, dtype=np.int64)
            good = bits * (100 + LEAST) <= (n + sizes[at]) * (100 - LEAST)
            yield x, ys[good].tolist(), gs[good].tolist()

    def by_text(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[int, list, list]]:
        def shingles(text: bytes) -> np.ndarray:
            raw = np.frombuffer(text, np.uint8)
            return shingle_sets(raw, np.array([0, len(raw)]))[0]

        text_of = dict(zip(right["y_node"], right["y_what"], strict=True))
        held: dict[int, np.ndarray] = {}
        for x, text, ys, gs in zip(left["node"], left["what"], left["ys"], left["gs"], strict=True):
            own, linked = shingles(text), {}
            for y, g in zip(ys.tolist(), gs.tolist(), strict=True):
                if g in linked:
                    continue
                other = held.get(y)
                if other is None:
                    other = held[y] = shingles(text_of[y])
                small, large = (own, other) if len(own) < len(other) else (other, own)
                common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                if 100 * common >= LEAST * (len(own) + len(other) - common):
                    linked[g] = y
            yield x, list(linked.values()), list(linked)

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        kept = [x for x in (by_sketch if wide else by_text)(left, right) if x[1]] if len(left) else []
        return pd.DataFrame({"node": np.array([x for x, _, _ in kept], np.int64), "ys": pd.Series([y for _, y, _ in kept], dtype=object), "gs": pd.Series([g for _, _, g in kept], dtype=object)})

    left = asking.groupBy("block", "salt").cogroup(asked.groupBy("y_block", "y_salt")).applyInPandas(check, "node long, ys array<long>, gs array<long>")
    return materialise(left.select("node", F.arrays_zip(F.col("ys").alias("y"), F.col("gs").alias("g")).alias("others")))


def _verified(asks: DataFrame, docs: DataFrame, nodes: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(a, b) links of asks (node, others): of each component g of `others` (y, g) one link of a block is enough."""
    near = _checked(materialise(asks), docs, nodes, True, block_chars)
    # the blocks' lists of a node are one again
    near = materialise(near.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others")))
    links = _checked(near, docs, nodes, False, block_chars)
    return links.select(F.col("node").alias("a"), F.explode("others.y").alias("b"))


def _classes(known: DataFrame, broadcast_bytes: int, chunk: int, block_chars: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of all rows with a doc_id, and (node, rep, owner, component_id): a class's smallest doc_id and the node that has it."""
    sets = materialise(_sets(known))
    nodes = materialise(sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *(F.first(f"s{k}").alias(f"s{k}") for k in range(SKETCH))))
    largest = nodes.agg(F.max("n")).first()[0] or 0
    edges = bands(largest)
    ends = F.array(*map(F.lit, edges))
    share = dict(nodes.groupBy((F.size(F.filter(ends, lambda e: e <= F.col("n"))) - 1).alias("band")).count().collect())
    schemes = {k: s for k in range(len(edges) - 1) if share.get(k) and (s := plan(k, edges[k], edges[k + 1] - 1, share[k] + share.get(k + 1, 0)))}
    labels = None
    if schemes:
        expected = sum((share[k] + share.get(k + 1, 0)) * s.segments for k, s in schemes.items())
        members = materialise(_members(known, Bitmap.of(nodes, "rep", sum(share.values())), schemes, edges, expected, broadcast_bytes))
        hubs = members.groupBy("sig").agg(F.min("node").alias("anode"))
        stars = members.join(hubs, "sig").where(F.col("node") != F.col("anode")).select("anode", F.col("node").alias("bnode")).distinct()
        stars = stars.join(_as(nodes, "a"), "anode").join(_as(nodes, "b"), "bnode").where(_near("a", "b")).select("anode", "bnode")
        links = _verified(stars.groupBy(F.col("bnode").alias("node")).agg(F.collect_set(F.struct(F.col("anode").alias("y"), F.col("anode").alias("g"))).alias("others")), known, nodes, block_chars)
        labels = spread_labels(links)
        # buckets that hold several components still
        labelled = members.join(labels, "node", "left").select("sig", "node", "tag", F.coalesce("label", "node").alias("label"))
        several = labelled.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).where(F.col("low") != F.col("high")).select("sig", "m")
        mixed = materialise(labelled.join(several, "sig"))
        crowded = mixed.where(F.col("m") > hot)
        bound = crowded.groupBy("node", "tag").agg(F.count_distinct("sig").alias("crowds")).where(F.col("crowds") >= F.shiftright("tag", 1)).drop("crowds")
        mixed = mixed.where(F.col("m") <= hot).unionByName(crowded.join(bound, ["node", "tag"], "left_semi"))
        more = _verified(_asks(mixed, nodes, chunk), known, nodes, block_chars)
        if more.limit(1).count():
            labels = spread_labels(links.union(more))
    named = nodes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")) if labels is not None else nodes.select("node", "rep", F.col("node").alias("label"))
    named = materialise(named)
    owners = named.groupBy("label").agg(F.min(F.struct("rep", "node")).alias("first"))
    return sets.select("doc_id", "n", "node"), named.join(owners, "label").select("node", "rep", F.col("first.node").alias("owner"), F.col("first.rep").alias("component_id"))


def jaccard_components(df: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, chunk: int = CHUNK, block_chars: int = BLOCK_CHARS, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of df (doc_id, text)."""
    docs = df.select("doc_id", "text")
    sets, classes = _classes(docs.where(F.col("doc_id").isNotNull()), broadcast_bytes, chunk, block_chars, hot)
    out = sets.join(classes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = docs.where(F.col("doc_id").isNull())
    rest = _sets(nameless).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)


def without_copies(df: DataFrame) -> DataFrame:
    """df's rows less those of every class's other documents: the smallest doc_id's row stays, with all its columns.

    Rows with null doc_id and rows without words stay. A doc_id with several texts loses only the texts that are near
    another document's (or, of two near texts of its own, one); equal rows of what stays all stay.
    """
    sets, classes = _classes(df.select("doc_id", "text").where(F.col("doc_id").isNotNull()), BROADCAST_BYTES, CHUNK, BLOCK_CHARS, HOT)
    stays = (F.col("node") == F.col("owner")) & (F.col("doc_id") == F.col("component_id"))
    gone = sets.join(classes, "node").where(~stays).select("doc_id", "node").distinct()
    node, key = fresh_name(df, "node"), fresh_name(df, "key")
    gone = materialise(gone).select(F.col("doc_id").alias(key), F.col("node").alias(node + "_"))
    named = _named(df, node)
    return named.join(gone, (F.col("doc_id") == F.col(key)) & (F.col(node) == F.col(node + "_")), "left_anti").select(*df.columns)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(k) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) c
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c.c >= 80 * (na.n + nb.n - c.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) q ON q.a = w.doc_id
"""
