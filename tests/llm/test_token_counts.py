import public_tokenizers
from brisa.llm.token_counts import MARK, Both, Counter, Merges, token_counts, vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st
from made import documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces=None):
    """Piece counts by the tokenizers library's unigram model over the same vocabulary."""
    from tokenizers import Tokenizer, models, pre_tokenizers
    pieces = pieces or vocabulary(PATH)
    low = min(s for _, s in pieces)
    model = models.Unigram([("<unk>", low)] + pieces + [(f"<0x{b:02X}>", low) for b in range(256)], 0, True)
    tok = Tokenizer(model)
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=True)
    return lambda text: len(tok.encode(text, add_special_tokens=False).ids)


TIES = [("a", -1.0), ("b", -1.0), ("aa", -2.0), ("ab", -2.0), ("aab", -3.0), (MARK, -1.0), (MARK + "a", -2.0), ("ba", -1.5)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc é\U0001F600", max_size=30))
def test_ties_and_unknown_as_the_library(text):
    assert Counter(TIES).count(text)[0] == library(TIES)(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_characters="<▁", exclude_categories=["Cs"]), max_size=40))
def test_whole_vocabulary_as_the_library(text):
    global _COUNTER, _LIBRARY
    if "_COUNTER" not in globals():
        _COUNTER, _LIBRARY = Counter(vocabulary(PATH)), library()
    assert _COUNTER.count(text)[0] == _LIBRARY(text)


BOTH, MERGES = Both(vocabulary(PATH), 50), Merges(vocabulary(PATH))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet="the aion▁\n\té\U0001F600", max_size=40), st.text(max_size=40, alphabet=st.characters(exclude_categories=["Cs"]))))
def test_words_counted_once_as_one_by_one(text):
    alone = Counter(vocabulary(PATH)) if "_ALONE" not in globals() else _ALONE
    globals()["_ALONE"] = alone
    got, want = BOTH.count(text), (MERGES.count(text), *alone.count(text))
    assert got[:3] == want[:3] and abs(got[3] - want[3]) < 1e-6 * (1 + abs(want[3]))


def test_edges(spark):
    df = documents(spark, [(1, None, None, None), (2, "", None, None), (3, "word " * 200_000, None, None), (None, "a", None, None)], ["score"])
    got = {r.doc_id: r for r in token_counts(df, PATH).collect()}
    assert (got[1].n_pieces, got[2].n_pieces, got[1].score) == (0, 0, 0.0)
    assert got[3].n_pieces >= 200_000 and got[None].n_pieces == 1
    assert token_counts(df.limit(0), PATH, keep=("doc_id", "score")).collect() == []
