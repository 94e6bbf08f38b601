import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weft.llm.op4_bpe import encode_documents, load_automaton

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return load_automaton(PATH), Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(both):
    own, library = both
    random.seed(3)
    pool = [*"aeioutshn'  \n\t.,!?-0129é²ßñ中😀%$", "'s", " the", "<|endoftext|>", "ation", "    ", "%%%", "aaaa"]
    for _ in range(3000):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert array("I", own.encode(text)).tolist() == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_every_token_reads_back(both):
    own, _ = both
    random.seed(1)
    for token, i in random.sample(sorted(own.live.items()), 3000):
        assert own.encode_word(token) == [i]


def test_rows(spark):
    df = spark.createDataFrame([(1, "the cat", 1), (1, "the cat", 2), (2, None, 3), (None, "", 4), (3, "a" * 50_000, 5)], "doc_id long, text string, n_tokens long")
    out = {(r.doc_id, r.n_tokens) for r in encode_documents(df, PATH).collect()}
    assert {(1, 2), (2, 0), (None, 0)} < out and encode_documents(df, PATH).count() == 5
    assert encode_documents(df.limit(0), PATH).count() == 0
