import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from orderlens.llm.token_counts import merger_of, token_counts

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeinrst ▁\n\t\r,.<s>/é日本😀\x00　"))))
def test_count_equals_the_library(text):
    assert merger_of(VOCABULARY).count(text) == len(LIBRARY.encode(text))


@pytest.mark.parametrize("text", ["", " ", "   a  b ", "\n", "a\n\n b", "▁▁x", " " * 33, "<s> hi</s>", "x" * 3000,
                                  "  \n  \n", "日本語 これは", "é", "﻿a"])
def test_count_of_odd_texts(text):
    merger = merger_of(VOCABULARY)
    assert merger.count(text) == len(LIBRARY.encode(text))
    if text:
        assert merger.merged("▁" + text.replace(" ", "▁")) == len(LIBRARY.encode(text))


def test_rows(spark, docs_of, weird):
    got = token_counts(docs_of(weird), VOCABULARY, limit=10).collect()
    want = [(i, len((t or "").encode()), n := len(LIBRARY.encode(t or "")), n > 10) for i, t in weird]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(docs_of([]), VOCABULARY).count() == 0


def test_clashing_columns(docs_of):
    docs = docs_of([(1, "a b", 7)], ("doc_id", "text", "n_tokens"), ("long", "string", "long"))
    assert token_counts(docs, VOCABULARY).collect()[0].n_tokens == 2


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: len(LIBRARY.encode(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, VOCABULARY).collect()} == want
