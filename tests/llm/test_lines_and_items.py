import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from weft.llm import op7_decontaminate as D
from weft.llm import op10_lines as L

UP = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute_lines(rows):
    keys = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                keys[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(keys.get(key(x), ())) < 3 or i == max(keys[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_lines_same_as_brute_force(spark, limit):
    rng = random.Random(4)
    pool = [f"Line {k} that many documents hold {'é' * (k % 3)}" for k in range(40)] + ["short", "", "  " + "x" * 19, "x" * 20 + "\t"]
    rows = [(rng.randrange(60), "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str])(rng.choice(pool)) for _ in range(rng.randrange(6)))) for _ in range(90)]
    rows += [(None, pool[0]), (70, None), (71, ""), rows[0]]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, h1 string")
    out = L.dedup_lines(df, broadcast_keys=limit, shard_keys=5)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=str)
    assert got == brute_lines(rows)
    assert L.dedup_lines(df.limit(0)).count() == 0
    extra = spark.createDataFrame([(i, t, 77, 78, 79) for i, t in rows], "doc_id long, text string, n_lines int, row int, gone int")
    kept = L.dedup_lines(extra, broadcast_keys=limit, shard_keys=5, counts=False)
    assert kept.columns == extra.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect() if (r.n_lines, r.row, r.gone) == (77, 78, 79)), key=str) == sorted(((r[0], r[3]) for r in got), key=str)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 5000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        assert sorted(L.PerfectHash.build(keys).slots(keys).tolist()) == list(range(n))


def brute_items(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for name, text in items:
            x = words(text)
            n = min(window, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x and name is not None else set()
            for k in range(len(w) - n + 1) if windows else ():
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(name))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,most", [(16_000_000, 1 << 26), (300, 1 << 26), (300, 1)])
def test_items_same_as_brute_force(spark, block, most):
    rng = random.Random(5)
    vocabulary = [f"v{k}é" if k % 5 == 0 else f"v{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(25)] + [(None, "v1 v2"), (99, None), (3, "v0é v1 v2")]
    rows = []
    for i in range(60):
        w = [rng.choice([*vocabulary, "zz"]) for _ in range(rng.choice([0, 5, 40, 200]))]
        if rng.random() < 0.6:
            w[3:3] = items[rng.randrange(25)][1].upper().split()
        rows.append((i, "-".join(w)))
    rows += [(None, rows[1][1]), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, spans int")
    out = D.find_items(df, spark.createDataFrame(items, "item_id long, text string"), item_chars=block, pass_bytes=most)
    got = sorted(((r.doc_id, r.n_words, sum(x.end - x.first for x in r.spans), sorted(r["items"])) for r in out.collect()), key=str)
    assert got == brute_items(rows, items)
    assert D.find_items(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = D.find_items(df, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("size(spans) > 0 or size(items) > 0").count() == 0 and none.count() == len(rows)


@pytest.mark.parametrize("most", [1 << 26, 1])
def test_cleaning(spark, most):
    item = " ".join(f"w{k}" for k in range(12))
    other = " ".join(f"u{k}" for k in range(11))
    rows = [(1, "before " + "x " * 30 + item + " after"), (2, item), (3, "clean text"), (4, None), (5, "y " * 90 + other + " z"), (5, "y"), (6, "é " * 40_000 + item)]
    df = spark.createDataFrame([(i, t, 7, "s", 9) for i, t in rows], "doc_id long, text string, n_words int, spans string, items int")
    items = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    out = D.clean_documents(df, items, item_chars=40, pass_bytes=most)
    assert out.columns == df.columns and {(r.n_words, r.spans, r["items"]) for r in out.collect()} == {(7, "s", 9)}
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "before " + "x " * 30 + " after"), (3, "clean text"), (4, None), (5, "y " * 90 + " z"), (5, "y"), (6, "é " * 40_000)], key=str)
    assert D.clean_documents(df.limit(0), items).count() == 0


def test_packed_automaton_is_small():
    rng = np.random.default_rng(2)
    items = [(str(k), rng.integers(0, 5000, 60).astype(np.uint64)) for k in range(1000)]
    assert D.ItemAutomaton(items).nbytes() < 80 * 60_000
