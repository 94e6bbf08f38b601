import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weft.llm import op13_alignment as op
from weft.llm.common import table
from weft.llm.op4_bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_tokens(libraries, text):
    """(A ids with byte ends, B ids with byte ends) of a whole text, or two empty lists."""
    a, b = libraries
    letters, want = byte_letters(), (" " + text).encode()
    ids = a.encode(" " + text, add_special_tokens=False).ids
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids]
    b_ids = b.encode(text, num_threads=1)
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return [], []
    out = []
    for who, parts in ((ids, a_bytes), (b_ids, b_bytes)):
        out.append(list(zip(who, np.cumsum([0, *map(len, parts)])[:-1].tolist(), np.cumsum(list(map(len, parts))).tolist(), strict=True)))
    return out


def plain_rows(libraries, rows):
    links, groups, sizes = [], [], []
    for _, text in rows:
        x, y = plain_tokens(libraries, text or "")
        own, j = Counter(), 0
        for i, s, e in x:
            while j and y[j][1] > s:
                j -= 1
            while j < len(y) and y[j][2] <= s:
                j += 1
            k = j
            while k < len(y) and y[k][1] < e:
                own[i, y[k][0]] += 1
                k += 1
        cuts, parts, p, q = sorted({t[2] for t in x} & {t[2] for t in y}), [], 0, 0
        for c in cuts:
            left, right = [], []
            while p < len(x) and x[p][2] <= c:
                left.append(str(x[p][0]))
                p += 1
            while q < len(y) and y[q][2] <= c:
                right.append(str(y[q][0]))
                q += 1
            parts.append(",".join(left) + "|" + ",".join(right))
        links.append(own)
        groups.append(hashlib.sha256(";".join(parts).encode()).hexdigest() if x else "")
        sizes.append((len(x), len(y), len(cuts)))
    count = Counter(p for own in links for p in own)
    top = Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return sorted(
        ((d, *n, sum(own.values()), sum(t for p, t in own.items() if count[p] == top[p[0]]), sum(t * count[p] for p, t in own.items()), g) for (d, _), n, own, g in zip(rows, sizes, links, groups, strict=True)), key=str
    )


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect()), key=str)


def test_whole_table_against_brute_force(spark, libraries):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = plain_rows(libraries, rows)
    assert rows_of(op.op13_alignment(spark, SF)) == want
    # most pairs too rare to be broadcast
    assert rows_of(op.scored_documents(table(spark, SF, "documents"), A, B, most=40)) == want


def test_odd_rows(spark, libraries):
    random.seed(5)
    pool = [*"abcdeXYZ   \n\t.,'!?-0129éßñ中文😀 ▁́ﬁ­\x00", " the ", "<|endoftext|>", "<s>", "</s>", "<0x41>", "    ", " 's", "ation", "½"]
    texts = ["".join(random.choices(pool, k=random.randint(0, 40))) for _ in range(400)]
    texts += [None, "", " ", "  ", "\n", " lead", "trail ", "a" * 30_000, "the same text", "the same text", "x y " * 20_000]
    rows = [(k // 2 if k % 7 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, pairs long")
    assert rows_of(op.scored_documents(df, A, B)) == plain_rows(libraries, rows)
    assert op.scored_documents(df.limit(0), A, B).count() == 0


def test_products_against_dense():
    random.seed(1)
    for _ in range(200):
        n = random.randint(1, 30)
        a, b = (np.array(sorted({n, *random.sample(range(1, n + 1), random.randint(0, n - 1))})) for _ in range(2))

        def dense(ends):
            return np.array([[float(s <= k < e) for k in range(n)] for s, e in zip([0, *ends], ends, strict=False)])

        def full(m):
            out = np.zeros((len(m.indptr) - 1, m.columns))
            out[m.rows, m.indices] = m.data
            return out

        assert (full(op.overlap_links(a, b)) == dense(a) @ dense(b).T).all()
        cuts = sorted(set(a) & set(b))
        group = [[sum(c < e for c in cuts) for e in ends] for ends in (a, b)]
        assert (full(op.group_links(a, b)) == np.equal.outer(*group)).all()


def test_forgetting_changes_nothing():
    texts = [f"some words {k} and more w{k % 7}" for k in range(60)]
    plain, forgetful = op.Aligner(A, B), op.Aligner(A, B, kept_bytes=0)
    for k in range(0, 60, 10):
        for x, y in zip(plain.align(texts[k : k + 10]), forgetful.align(texts[k : k + 10]), strict=True):
            assert x[1] == y[1] and all((p == q).all() for p, q in zip((x[0], *x[2:]), (y[0], *y[2:]), strict=True))
