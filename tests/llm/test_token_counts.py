import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arenaflow.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merges():
    return tc.load_merges(PATH)


def texts():
    rng = random.Random(3)
    alphabet = list("abcdehint  \n\t.,'!?$%019éüñ中文😀\u00a0\u0085\u200b\x1c\x1f\u3000İ²½") + ["<|endoftext|>", "'s", "'ll", " the", "aaaa"]
    made = ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(300)]
    return [*made, "", " ", "a" * 3000, "<|endoftext|>" * 3, "ab" * 500 + " " * 40]


def test_counts_equal_the_library(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(-1, None, "x"), (-1, None, "x")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in tc.count_tokens(docs, PATH).collect()}
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t for _, t in rows], add_special_tokens=False)]
    assert [got[i].n_tokens for i, _ in rows] == want
    assert [got[i].n_bytes for i, _ in rows] == [len(t.encode()) for _, t in rows]
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.values())
    assert (got[-1].n_bytes, got[-1].n_tokens) == (0, 0)
    assert tc.count_tokens(docs.filter("false"), PATH).count() == 0


def test_other_options_are_refused(tmp_path):
    p = tmp_path / "v.json"
    p.write_text(open(PATH, encoding="utf-8").read().replace('"add_prefix_space": false', '"add_prefix_space": true').replace('"add_prefix_space":false', '"add_prefix_space":true'))
    with pytest.raises(ValueError):
        tc.load_merges(str(p))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    lib = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in rows}
    assert {r.doc_id: r.n_tokens for r in tc.count_tokens(docs, PATH).collect()} == want
