"""The pipeline's stages against brute force, each on what the one before it kept."""

import hashlib
from array import array

import corpus_pipeline as C
import public_tokenizers
from test_jaccard import brute as brute_components
from test_lines_and_items import brute_items, brute_lines
from tokenizers import Tokenizer

from weft.llm import op1_toxicity
from weft.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    docs = table(spark, SF, "documents")
    columns = docs.columns
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    out = C.toxicity(spark, docs, SF).persist()
    model = op1_toxicity.fit(docs, table(spark, SF, "labels"))
    scores = {r.doc_id: r.score for r in op1_toxicity.score_documents(docs, model).collect()}
    assert out.columns == columns and {i for i, _ in pairs(out)} == {i for i, s in scores.items() if s < 0.7}

    before, docs = pairs(out), out
    out = C.line_dedup(spark, docs, SF).persist()
    assert out.columns == columns and sorted(pairs(out)) == sorted((i, t) for i, _, _, t in brute_lines(before))
    assert all(r.n_chars == len(r.text) for r in out.collect())

    before, docs = pairs(out), out
    out = C.near_duplicates(spark, docs, SF).persist()
    label = brute_components(before)
    assert out.columns == columns and sorted(pairs(out)) == sorted((i, t) for i, t in before if label[i][1] == i)

    before, docs = pairs(out), out
    out = C.decontamination(spark, docs, SF).persist()
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = {i: (n, k) for i, n, k, _ in brute_items(before, items)}
    got = dict(pairs(out))
    assert out.columns == columns and set(got) == {i for i, _ in before if hit[i][1] <= hit[i][0] / 2}
    assert all(got[i] == t for i, t in before if not hit[i][1]) and all(k == 0 for _, _, k, _ in brute_items([(i, t) for i, t in got.items() if hit[i][1]], items))

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = {r.doc_id: r for r in C.bpe(spark, out, SF).collect()}
    assert set(last) == set(got)
    for i, t in got.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert last[i].ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest() and last[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert C.run(spark, SF).count() == len(got)


def test_odd_rows_and_columns(spark):
    """Nulls, repeated doc_ids, and columns named as the operators name theirs: each stage against brute force."""
    line = "a line that is long enough and that three documents share"
    copy = " ".join(f"w{k}" for k in range(40))
    rows = [(1, copy), (5, "something else\n" + line), (5, copy), (5, copy), (6, line + "\nsix"), (8, line + "\n" + copy), (9, None), (None, copy), (None, None), (10, ""), (11, "x" * 300_000 + "\n" + line)]
    item = table(spark, SF, "benchmark").where("text is not null").first().text
    filler = "".join(f"z{k} " for k in range(400))
    rows += [(12, item), (13, filler + item)]
    extra = {"n_lines": 77, "n_words": 78, "spans": 79, "items": 80, "node": 81, "toxicity": 82, "score": 83, "row": 84, "key": 85, "at": 86, "shard": 87}
    df = spark.createDataFrame([(i, t, *extra.values()) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{k} int" for k in extra)).repartition(3)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    def kept(out):
        assert out.columns == df.columns
        assert all(r[k] == v for r in out.collect() for k, v in extra.items())
        return pairs(out)

    assert len(kept(C.toxicity(spark, df, SF))) == len(rows)
    assert sorted(((i, t or "") for i, t in kept(C.line_dedup(spark, df, SF))), key=str) == sorted(((i, t) for i, _, _, t in brute_lines(rows)), key=str)
    assert kept(C.near_duplicates(spark, df, SF)) == sorted([r for r in rows if r != (5, copy)], key=str)
    got = kept(C.decontamination(spark, df, SF))
    assert (12, item) not in got and len(got) == len(rows) - 1 and [t.strip(" .") for i, t in got if i == 13] == [filler.strip()]
    assert C.bpe(spark, df, SF).count() == len(rows)
    for _, stage in C.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
