"""Token counts against sentencepiece itself."""

import public_tokenizers
import sentencepiece
from brisa.llm.token_counts import Merges, token_counts, vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st
from made import SF001, documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MERGES = Merges(vocabulary(PATH))


def library(text):
    return len(LIBRARY.encode(text, num_threads=1))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40),
                 st.text(alphabet="the aion▁\n\t<0x>é\U0001F600", max_size=40)))
def test_any_text(text):
    assert MERGES.count(text) == library(text)


def test_long_words_and_edges():
    for text in ("", " ", "a" + 8 * " " + "b", "the quick brown internationalization", "ab" * 20_000, " " * 1000 + "x", "一二三" * 500):
        assert MERGES.count(text) == library(text)


def test_every_document(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in token_counts(docs, PATH).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: library(t) for i, t in texts.items()}
    print("tokens", sum(r.n_tokens for r in got.values()), "pieces", sum(r.n_pieces for r in got.values()),
          "differ", sum(r.n_tokens != r.n_pieces for r in got.values()))
    odd = token_counts(documents(spark, [(1, None, None, None), (2, "", None, None)], ["n_tokens"]), PATH, keep=("doc_id", "n_tokens"))
    assert [r.n_tokens for r in odd.collect()] == [0, 0]
