"""Online trees against one row after another in plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import online


def u(seed, *keys):
    return int(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16) / 4294967296.0


def one_by_one(rows, tree, seed, lifetime, width):
    nodes = {1: {"f": None, "t": None, "tau": 0.0, "n": 0, "s": [0.0] * width, "lo": None, "hi": None}}
    for key, x, y in sorted(rows):
        at = 1
        while True:
            me = nodes[at]
            me["n"] += 1
            me["s"] = [a + b for a, b in zip(me["s"], y, strict=True)]
            lo, hi = me["lo"] or list(x), me["hi"] or list(x)
            me["lo"], me["hi"] = [min(a, b) for a, b in zip(lo, x, strict=True)], [max(a, b) for a, b in zip(hi, x, strict=True)]
            if me["f"] is not None:
                at = 2 * at + (x[me["f"]] > me["t"])
                continue
            steps = [max(a - v, 0) + max(v - b, 0) for a, b, v in zip(lo, hi, x, strict=True)]
            total = sum(steps)
            if total > 1e-15:
                tau = me["tau"] - math.log(1 - u(seed, tree, at, key)) / total
                if tau < lifetime:
                    cum, f = 0.0, 0
                    for k, s in enumerate(steps):
                        cum += s
                        if u(seed + 1, tree, at, key) * total <= cum:
                            f = k
                            break
                    r = u(seed + 2, tree, at, key)
                    t = x[f] + r * (lo[f] - x[f]) if x[f] < lo[f] else hi[f] + r * (x[f] - hi[f])
                    empty = {"f": None, "t": None, "tau": tau, "n": 0, "s": [0.0] * width, "lo": None, "hi": None}
                    same = dict(me, tau=tau)
                    nodes[2 * at], nodes[2 * at + 1] = (empty, same) if x[f] < lo[f] else (same, empty)
                    me |= {"f": f, "t": t, "tau": tau}
            break
    return {(tree, k, v["f"], *(None if z is None else round(z, 9) for z in (v["t"], v["tau"])), v["n"], *v["s"], *(round(z, 9) for b in ("lo", "hi") for z in v[b] or ())) for k, v in nodes.items()}


def told(nodes):
    six = lambda x: None if x is None else round(x, 9)
    return {(r.tree, r.node, r.feature, six(r.threshold), six(r.tau), r.n, *r.sums, *(six(z) for b in (r.los, r.his) for z in b if z is not None)) for r in nodes.collect()}


@pytest.mark.parametrize("range_of_keys", [3, 1 << 16])
def test_same_as_one_row_after_another(spark, monkeypatch, range_of_keys):
    monkeypatch.setattr(online, "RANGE", range_of_keys)
    random.seed(9)
    rows = [(k * 2, [random.random(), random.choice([0.1, 0.5, 0.9]), 1.0], random.choice([[1.0, 0.0], [0.0, 1.0]])) for k in range(60)]
    rows += [(200, [0.5, 0.5, 1.0], [1.0, 0.0]), (201, [0.5, 0.5, 1.0], [0.0, 1.0])]
    want = set().union(*(one_by_one(rows, t, 5, 9.0, 2) for t in range(2)))
    how = {"trees": 2, "features": 3, "width": 2, "seed": 5, "lifetime": 9.0}
    df = spark.createDataFrame(rows, "key bigint, x array<double>, y array<double>")
    start = online.roots(spark, 2, 3, 2)
    nodes = online.fold(start, df, **how)
    assert told(nodes) == want and len(want) > 10
    if range_of_keys > 3:
        # a batch more goes on from where the last one ended; shuffled node tables change nothing
        monkeypatch.setattr(online, "BROADCAST_NODES", 0)
        nodes = online.fold(start, df.where("key < 40"), **how)
        assert told(online.fold(nodes, df.where("key >= 40"), **how)) == want
        nulls = spark.createDataFrame([(None, [0.0, 9.0, 9.0], [1.0, 0.0]), (500, [7.0, 7.0, 7.0], None)], df.schema)
        assert told(online.fold(nodes, nulls, **how)) == told(nodes)
        assert told(online.fold(start, df.limit(0), **how)) == told(start)


def test_a_batch_may_run_twice(spark, tmp_path):
    how = {"trees": 1, "features": 1, "width": 1, "seed": 1, "lifetime": 5.0}
    start = online.roots(spark, 1, 1, 1)
    rows = spark.range(30).select(F.col("id").alias("key"), F.array((F.col("id") * 7 % 11).cast("double")).alias("x"), F.array(F.lit(1.0)).alias("y"))
    first, second = rows.where("key < 15"), rows.where("key >= 15")
    for batch, k in ((first, 0), (second, 1), (second, 1)):
        online.fold_stream(batch, k, str(tmp_path), start, **how)
    assert told(spark.read.parquet(f"{tmp_path}/nodes-000001")) == told(online.fold(start, rows, **how))


def test_rows_inside_the_box_are_not_ordered(spark):
    """Of rows past a leaf's first range of keys, those that widen its box are kept and few others."""
    rows = spark.range(4000).selectExpr("0 AS tree", "1L AS node", "id AS key", "pmod(xxhash64(id), 100003) / 100003D AS x0", "floor(id / 100) AS range")
    ranges = rows.groupBy("tree", "node", "range").agg(F.min("x0").alias("lo0"), F.max("x0").alias("hi0"))
    kept = {r.key for r in online._survivors(rows, online.roots(spark, 1, 1, 1), ranges, 1, True).collect()}
    lo, hi, widening = 2.0, -1.0, set()
    for r in rows.orderBy("key").collect():
        if not lo <= r.x0 <= hi:
            widening.add(r.key)
        lo, hi = min(lo, r.x0), max(hi, r.x0)
    assert widening <= kept and set(range(100)) <= kept and len(kept) < 400
