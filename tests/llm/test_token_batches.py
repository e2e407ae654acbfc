"""New words counted together, as one by one."""

import random

import public_tokenizers
from brisa.llm.token_counts import MARK, Both, Counter, Merges, vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st

PIECES = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
BOTH = Both(PIECES, 40)
TIES = [("a", -1.0), ("b", -1.0), ("aa", -2.0), ("ab", -2.0), ("aab", -3.0), (MARK, -1.0), (MARK + "a", -2.0), ("ba", -1.5)]
NO_SINGLE = [("a", -1.0), ("ab", -2.0), (MARK, -1.0)]  # a character that is in a piece and none itself


def same(texts, pieces, both):
    merges, counter = Merges(pieces), Counter(pieces)
    for text, got in zip(texts, both.counts(texts), strict=True):
        want = (merges.count(text), *counter.count(text))
        assert got[:3] == want[:3] and abs(got[3] - want[3]) < 1e-6 * (1 + abs(want[3])), (text, got, want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="the aion▁\n\té\U0001F600", max_size=60), st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60)), max_size=6))
def test_whole_vocabulary(texts):
    same(texts, PIECES, BOTH)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc é\U0001F600", max_size=40), max_size=5), st.sampled_from([TIES, NO_SINGLE]))
def test_ties_and_pieces_of_no_single(texts, pieces):
    same(texts, pieces, Both(pieces, 3))


def test_new_words_are_not_counted_one_by_one(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 12))) + rng.choice(["", ".\n", ","]) for _ in range(200))
             for _ in range(30)]
    want, asked = [Both(PIECES).count(t) for t in texts], []
    both = Both(PIECES)
    one = both.merges.word
    monkeypatch.setattr(both.merges, "word", lambda w: asked.append(w) or one(w))
    assert list(both.counts(texts)) == want
    assert len(both.known) > 1000 and len(asked) < 10
