"""What the verification of candidates costs, and that cheap answers are the exact ones."""

import random

import numpy as np
import pytest
from brisa.llm import editwalk
from brisa.llm.batches import stage
from made import documents
from test_edit_classes import plain


def changed(rng, text, edits, alphabet):
    out = list(text)
    for _ in range(edits):
        k, kind = rng.randrange(len(out) + 1), rng.random()
        if kind < 0.5:
            out[k:k + 1] = rng.choice(alphabet)
        elif kind < 0.7:
            out[k:k] = out[:rng.randrange(9)]
        else:
            del out[k:k + rng.randrange(4)]
    return "".join(out)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é\U0001F600"])
def test_bounds_and_bands_against_plain_distances(alphabet):
    rng = random.Random(8)
    for _ in range(150):
        a = "".join(rng.choice(alphabet) for _ in range(rng.randrange(150)))
        b, most = changed(rng, a, rng.randrange(20), alphabet), rng.randrange(30)
        want = plain(a, b)
        assert editwalk.within(a, b, most) == (want <= most), (a, b, most)
        assert editwalk.edit_distance(a, b, most) == (want if want <= most else None)
        at, to, x, y = editwalk._core(a, b)
        assert editwalk._bound(a[at], b[to], x, y, most, len(a) + len(b)) >= want
        long, short = sorted((a, b), key=len, reverse=True)
        if short and most < len(long) <= len(short) + most:
            assert editwalk._by_band(long, short, most) == (want if want <= most else None)


def test_near_copies_are_linked_without_their_distance(monkeypatch):
    def never(*_):
        raise AssertionError("the whole distance was computed")

    for name in ("_distance", "_by_diagonals"):
        monkeypatch.setattr(editwalk, name, never)
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000))
    near = changed(rng, text, 500, "xyz")
    assert editwalk.within(text, near, len(text) // 10)
    assert editwalk.within(text, text[:5000] + near[5000:9000] + text[9040:], len(text) // 10)


def test_counts_bound_the_distance():
    rng = random.Random(10)
    for alphabet in ("ab", "abcdefgh \u00e9\U0001F600"):
        for _ in range(150):
            a = "".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))
            b = changed(rng, a, rng.randrange(20), alphabet)
            codes = np.frombuffer((a + b).encode("utf-32-le"), dtype=np.uint32)
            x, y = editwalk.pair_counts(codes, np.array([len(a), len(b)])).astype(int)
            assert max((x - y).clip(0).sum(), (y - x).clip(0).sum()) <= 2 * plain(a, b), (a, b)


def test_hot_buckets_make_few_candidates(spark, monkeypatch):
    rows, rng = [], random.Random(11)

    def spy(df, name, *args):
        out = stage(df, name, *args)
        if name == "edit-pairs":
            rows.append(out.count())
        return out

    def words(n, letters="abcdefghij"):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))

    monkeypatch.setattr(editwalk, "stage", spy)
    start, base = words(150), words(400)
    docs = [(i, start + words(150, rng.sample("klmnopqrstuvwxyz", 4)), "en", "a") for i in range(60)]  # unlike texts that share bands
    docs += [(100 + i, base[:20 * i] + "XY" + base[20 * i + 2:], "en", "a") for i in range(60)]  # near copies
    got = {r.doc_id: r.class_id for r in editwalk.with_classes(documents(spark, docs)).collect()}
    assert got == {i: i for i in range(60)} | {100 + i: 100 for i in range(60)}
    assert sum(rows) <= 2 * len(docs)  # not the 1770 pairs of a bucket
