"""Inputs larger than any fixed limit are worked on as a whole."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weft.llm import op1_toxicity as T
from weft.llm import op6_lm as M


def character_model():
    grams = Counter()
    for w, n in {"idiot": 50, "moron": 40, "the": 400, "that": 200, "stupid": 30, "is": 200, "you": 100, "and": 300}.items():
        w = f"  {w} "
        for k in range(len(w) - 2):
            grams[w[k : k + 3]] += n
    return T.CharacterModel(grams)


def test_toxic_word_after_a_thousand_spaced_letters():
    spaced = " ".join("thatandyou" * 100) + " " + " ".join("idiot")
    model = T.ToxicityModel(character_model(), {"idiot=": 5.0})
    assert "idiot" in T.restore(spaced, model.characters)
    assert model.summary(spaced)[0] == 5.0
    assert T.spaced_stretches(spaced) == [spaced]


def test_long_tokens_are_restored():
    model = character_model()
    assert T.restore_word("st" + "u" * 200 + "pid", model) == "stupid"
    assert T.restore_word("1d10t" + "that" * 20, model) == "idiot" + "that" * 20
    assert T.restore_word("st" + "u" * 200_000 + "pid", model) == "stupid"


def test_reading_same_as_with_path_strings():
    def by_paths(text, model):
        live = [{} for _ in range(len(text) + 1)]
        live[0][" "] = (0.0, "")
        for k in range(len(text)):
            for state, (cost, path) in live[k].items():
                for out, to, price in T.arcs(text, k):
                    s, total = state, cost + price
                    for c in out:
                        total -= model.log_p(s[-2:].rjust(2), c)
                        s = (s + c)[-2:]
                    if s not in live[to] or total < live[to][s][0]:
                        live[to][s] = (total, path + out)
        return min((cost - model.log_p(s[-2:].rjust(2), " "), path) for s, (cost, path) in live[-1].items())[1]

    rng, model = random.Random(5), character_model()
    for _ in range(300):
        text = "".join(rng.choice("idot1104$ .-uuu") for _ in range(rng.randrange(1, 60)))
        assert T.viterbi(text, model) == by_paths(text, model)


def test_filter_grows_with_its_entries(spark):
    """Each of 12,500 pages takes what its entries need, here 40,000 entries for one page."""
    rng = np.random.default_rng(4)
    h, other = (rng.integers(0, 2**40, 40_000).astype(np.uint64) << np.uint64(24) for _ in range(2))  # all of page 0
    entries = spark.createDataFrame(M.packed(h, np.ones(len(h), np.int64), 12_500).to_pandas(), "page int, entries binary")
    own = M.collected(M.filter_pages(entries, 1), 12_500, 1)
    assert own.bits[0] >= M.BITS_PER_ENTRY * len(np.unique(h)) and not own.bits[1:].any()
    assert (own.probe(h) > 0).all()
    assert (own.probe(other) > 0).mean() < 0.01


def test_joined_pages_give_the_same_scores(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices([f"w{j}" for j in range(300)], k=rng.randrange(80)))) for k in range(300)] + [(300, None), (301, "A a A"), (301, "A a A")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = docs.where("doc_id % 3 > 0")
    told = lambda: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in M.score_documents(docs, train).collect())
    want = told()
    monkeypatch.setattr(M, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(M, "PAGE_PROBES", 300)  # several copies of a page
    assert told() == want and len(want) == len(rows)
    assert M.score_documents(docs.limit(0), train).count() == 0


def test_joined_pages_store_less_than_the_texts(spark, monkeypatch):
    """No hashes of tokens are written, and rows to learn from may be named by a condition."""
    from pathlib import Path

    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(20_000)]
    docs = spark.createDataFrame([(k if k else None, " ".join(rng.choices(vocabulary, k=200))) for k in range(1_000)], "doc_id long, text string").repartition(2)
    stored, write = [], M.materialise

    def noted(df):
        out = write(df)
        stored.extend(Path(f.removeprefix("file:")).stat().st_size for f in out.inputFiles())
        return out

    monkeypatch.setattr(M, "materialise", noted)
    monkeypatch.setattr(M, "BROADCAST_BYTES", 100)
    told = lambda train: sorted(((r.doc_id or 0), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in M.score_documents(docs, train).collect())
    want = told(docs.where("doc_id % 3 > 0"))
    assert sum(stored) < 0.8 * docs.selectExpr("sum(octet_length(text))").first()[0]
    assert told(F.expr("doc_id % 3 > 0")) == want and len(want) == 1_000
    monkeypatch.undo()
    assert told(F.expr("doc_id % 3 > 0")) == want


def test_numbers_squeezed_come_back():
    rng = np.random.default_rng(5)
    for m in (0, 1, 1_000):
        columns = [rng.integers(0, 2**64, m, dtype=np.uint64), rng.integers(0, 3, m)]
        assert all((x == y).all() for x, y in zip(M.spread(M.squeezed(*columns), m, 2), columns, strict=True))


def test_pairs_seen_once_count(spark):
    train = spark.createDataFrame([(k, f"common a{k} b{k}") for k in range(50)], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a7 b7"), (2, "a7 b8")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in M.score_documents(docs, train).collect()}
    assert score[1] > score[2] + 1e-6


def test_long_words_that_share_a_polynomial():
    from weft.llm.common import text_blocks, word_hashes

    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    mirror = word.translate(str.maketrans("ab", "ba"))
    texts = [word, mirror, f"x {word.upper()} y {mirror}", word[:256], mirror[:256]]
    told = []
    for _, _, data, offsets in text_blocks(pa.array(texts)):
        h, first = word_hashes(data, offsets)
        told += [h[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]
    assert told[0] != told[1] and told[2][1] == told[0][0] and told[2][3] == told[1][0] and told[3] != told[4]
