import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from weft.llm import op12_spelling as op
from weft.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_words(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    out = {}
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) <= 1 and near(w, x)]
        form = min(others, key=lambda x: (-words[x], x), default=None)
        out[w] = (n, len(others), form if form and words[form] >= 10 * n else None)
    return {(w, f, root(out, w), n, k, words.get(f)) for w, (n, k, f) in out.items()}


def root(out, w):
    while out[w][2]:
        w = out[w][2]
    return w


def rows(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = rows(op.op12_spelling(spark, SF))
    assert sorted(got, key=str) == sorted(con.execute(op.SQL).fetchall(), key=str) and any(x[1] for x in got)
    texts = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert {x[0]: x[3] for x in got} == plain_words(texts)


@pytest.mark.parametrize("small", [1, 3, 64])
def test_against_brute_force(spark, small):
    random.seed(small)
    base = ["".join(random.choices("abé", k=random.randint(7, 9))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "ababababab", "ßÿ×÷àáâ"]
    words = [w for w in base for _ in range(40)]
    for w in base:
        for _ in range(12):
            k = random.randrange(len(w) + 1)
            words += [random.choice([w[:k] + random.choice("abcé") + w[k:], w[:k] + w[k + 1 :], w[:k] + "b" + w[k + 1 :]])] * random.randint(1, 5)
    random.shuffle(words)
    texts = [(i, " ".join(words[k : k + 50]).upper() if i % 3 == 0 else "-".join(words[k : k + 50])) for i, k in enumerate(range(0, len(words), 50))]
    texts += [(None, "wordone wordone"), (1, None), (1, ""), (7, "wordone"), (7, "wordone " * 3000)]
    df = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, word string, n long")
    want = plain_variants(plain_words(texts))
    got = rows(op.spelling_variants(df, small=small))
    assert len(got) == len(set(got)) and set(got) == want
    assert op.spelling_variants(df.limit(0)).count() == 0


def test_near_words_share_a_signature():
    random.seed(2)
    for _ in range(2000):
        w = "".join(random.choices("abcdeé", k=random.randint(7, 14)))
        k = random.randrange(len(w))
        other = w[:k] + random.choice("fghß") + w[k + 1 :]
        more = w[:k] + random.choice("abz") + w[k:]
        a, b, c = map(op.signatures, (w, other, more))
        assert set(a["equal"]) & set(b["equal"]) and set(a["short"]) & set(c["long"])
