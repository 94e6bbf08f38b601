import random

import numpy as np
import pytest

from weft.llm import op9_jaccard as J
from weft.llm.components import Bitmap, spread_labels


def brute(rows):
    def words(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ")

    sets = {}
    for i, t in rows:
        w = [x for x in words(t) if x]
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    rows, last = [], None
    for i in range(260):
        kind = rng.random()
        if last and kind < 0.55:
            w = list(last)
            for _ in range(rng.choice([0, 1, 1, 2, 3, max(1, len(w) // 60)])):
                k = rng.randrange(len(w)) if w else 0
                w[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [x.upper() for x in w[k : k + 1]], [*w[k : k + 1], "x"]])
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 6, 8, 9, 12, 15, 20, 30, 60, 120, 400]))]
            if kind > 0.8:
                w += shared
        last = w or ["z"]
        rows.append((i * 3, " ".join(w)))
    rows += [(1, None), (2, ""), (4, " \t\n")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # by default, and with signatures joined, buckets in chunks and texts in small blocks
    for limits in [{}, {"broadcast_bytes": 0, "chunk": 3, "block_chars": 600, "hot": 2}]:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, **limits).collect()}
        assert got == brute(rows)


def test_near_copies_beyond_the_smallest(spark):
    """A bucket whose smallest member links with few of the others: chains of small steps from one text."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(60)] = rng.choice("xyz")
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, chunk=40, hot=5).collect()}
    assert got == brute(rows)


def test_compared_pairs():
    rng = np.random.default_rng(1)
    n = rng.integers(40, 60, 300)
    sketch, label = rng.integers(-(2**63), 2**63 - 1, (300, 8)), rng.integers(0, 40, 300)
    sketch[:100] = sketch[0] ^ (1 << rng.integers(0, 8, (100, 8)))
    near = lambda i, j: label[i] != label[j] and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]) and 180 * sum((int(x) & (1 << 64) - 1).bit_count() for x in sketch[i] ^ sketch[j]) <= 20 * (n[i] + n[j])
    one = np.zeros(300, np.int64)
    assert set(zip(*(x.tolist() for x in J.near_rows(n, sketch, label, one)), strict=True)) == {(i, j) for i in range(300) for j in range(i + 1, 300) if near(i, j)}
    run = np.sort(rng.integers(0, 30, 300))
    assert set(zip(*(x.tolist() for x in J.near_in_runs(run, n, sketch, label)), strict=True)) == {(i, j) for i in range(300) for j in range(i + 1, 300) if run[i] == run[j] and near(i, j)}
    two = rng.integers(0, 2, 300)
    assert set(zip(*(x.tolist() for x in J.near_rows(n, sketch, label, two)), strict=True)) == {(i, j) for i in range(300) for j in range(300) if two[i] < two[j] and near(i, j)}


def test_without_copies(spark):
    one, other = "a b c d e f", "g h i j k l m"
    rows = [(1, one, "p", 7), (5, other, "q", 8), (5, one, "r", 9), (8, other, "s", 1), (9, None, "t", 2), (None, one, "u", 3), (1, one, "v", 4), (7, "", "w", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, n long")
    got = J.without_copies(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([r for r in rows if r[2] not in "rs"], key=str)
    assert J.without_copies(df.limit(0)).count() == 0


def test_edges_of_input(spark):
    df = spark.createDataFrame([(5, "a b c d e f", "x"), (5, "a b c d e f", "y"), (7, "A B c d e f", "z"), (None, "a b c d e f", "w")], "doc_id long, text string, node string")
    got = sorted(J.jaccard_components(df).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(5, 2, 5), (5, 2, 5), (7, 2, 5), (None, 2, None)], key=str)
    assert J.jaccard_components(df.limit(0)).count() == 0


def test_schemes_cover_the_bound():
    edges = J.bands(5000)
    for k in range(len(edges) - 1):
        s = J.plan(k, edges[k], edges[k + 1] - 1, 1000)
        if s:
            assert s.units >= s.bound + 1 + s.slack and 2 * s.pairs <= s.units
        for a in range(edges[k], edges[k + 1]):
            assert a * 100 // 80 < edges[min(k + 2, len(edges) - 1)] or k + 2 >= len(edges)


def test_signatures_meet_for_every_link():
    rng = np.random.default_rng(0)
    edges = J.bands(4000)
    schemes = {k: s for k in range(len(edges) - 1) if (s := J.plan(k, edges[k], edges[k + 1] - 1, 50))}
    for _ in range(400):
        n = int(rng.choice([5, 6, 9, 10, 14, 20, 33, 70, 200, 900]))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        same = int(np.ceil(0.8 * n)) + int(rng.integers(0, max(1, n // 8)))
        b = np.concatenate([a[: min(n, same)], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 10) + 1))).astype(np.uint64)])
        inter = len(np.intersect1d(a, b))
        if 100 * inter < 80 * (len(a) + len(b) - inter):
            continue
        both = np.concatenate([np.sort(a), np.sort(b)])
        sig, row, tag = J.signatures(both, np.array([0, len(a), len(a) + len(b)]), schemes, np.array(edges))
        if len(a) != len(b) or inter != len(a):
            shared = set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())
            assert shared
            # what a set must share with any partner, by the scheme that both have
            band = [int(np.searchsorted(edges, len(x), side="right")) - 1 for x in (a, b)]
            for r in (0, 1):
                own = (row == r) & (tag % 2 == band[r] - min(band))
                sure = tag[own].max(initial=0) // 2
                assert len(shared & set(sig[own].tolist())) >= sure


def test_chain_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(101, 100), (70, 5)], "a long, b long")
    got = dict(map(tuple, spread_labels(links).collect()))
    assert set(got) == {*range(61), 70, 100, 101} and {got[k] for k in [*range(61), 70]} == {0} and got[100] == got[101] == 100


def test_bitmap_misses_none(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    bitmap = Bitmap.of(df.where("k % 3 = 0"), "k")
    at = df.select("k", bitmap.place("k").alias("at")).toPandas()
    assert set(at["k"][bitmap.mask(at["at"].to_numpy())]) == {k for k in range(1000) if k % 3 == 0}


def test_very_long_text(spark):
    rng = random.Random(3)
    w = [rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(150_000)]
    rows = [(3, " ".join(w)), (4, " ".join(w[:140_000])), (5, " ".join(w[:20_000]))]
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v[1] for k, v in brute(rows).items()} == got
