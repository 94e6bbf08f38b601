import random
import re

import pytest
import xxhash

from weft.llm import op11_simhash as op
from weft.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    got = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in got) > len(got))


def plain_components(rows):
    """rows: (doc_id, fingerprint); the smallest doc_id reachable from each fingerprint."""
    prints = sorted({f for _, f in rows})
    home = {f: f for f in prints}

    def root(f):
        while home[f] != f:
            f = home[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                home[root(a)] = root(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return {f: least.get(root(f)) for f in prints}


def agree(spark, df):
    texts = [(r.doc_id, plain_print(r.text)) for r in df.select("doc_id", "text").collect()]
    want = plain_components(texts)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in op.near_documents(df).collect()), key=str)
    assert got == sorted(((d, f"{f:016x}", want[f]) for d, f in texts), key=str)


def test_whole_table(spark):
    agree(spark, table(spark, SF, "documents"))


def test_odd_rows(spark):
    near = " ".join(f"word{k}" for k in range(300))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "two words"), (4, "Two WORDS"), (5, near), (6, near + " more"), (None, near), (None, "alone here now"), (7, near), (8, "a b c\u0085d e É")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, print string, node long")
    agree(spark, df)
    assert op.near_documents(df.limit(0)).count() == 0


def test_long_texts_in_stretches(monkeypatch):
    random.seed(4)
    text = " ".join("".join(random.choices("abcDE é", k=random.randint(1, 9))) for _ in range(2000)) + "x" * 5000 + " end"
    want = plain_print(text)
    for most in (7, 100, 4096):
        monkeypatch.setattr(op._stretches, "__defaults__", (most,))
        assert op.fingerprint(text) == want


@pytest.mark.parametrize("small", [1, 4, 64])
def test_blocks_of_any_size_give_the_same_components(spark, small):
    """Dense clusters, chains two bits a step, and pairs just too far apart."""
    random.seed(small)
    prints = {0, 3, 7, (1 << 64) - 1, 1 << 63}
    for _ in range(3):
        base = random.getrandbits(64)
        for _ in range(60):
            prints.add(base ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4))))
        x = base
        for _ in range(20):
            x ^= sum(1 << b for b in random.sample(range(64), random.choice([2, 3])))
            prints.add(x)
    signed = [op._signed(f) for f in sorted(prints)]
    want = plain_components([(op._signed(f), f) for f in prints])
    links = op.near_fingerprints(spark.createDataFrame([(x,) for x in signed], "node long"), small=small)
    from weft.llm.components import spread_labels

    got = {r.node: r.label for r in spread_labels(links).collect()}
    for f, label in want.items():
        assert got.get(op._signed(f), op._signed(f)) == label
