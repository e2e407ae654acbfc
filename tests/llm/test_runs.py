"""Periodic runs against plain comparison of every distance."""

import random

import numpy as np
from pyspark.sql import functions as F

from brisa.llm.queries import repeated_tail
from brisa.llm.runs import derive, find_runs, periodic_runs
from made import documents


def plain(words):
    """(start, end, period) of all runs, trying every period."""
    best = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in best.items())


def collapsed(words):
    gone = {i for s, e, q in plain(words) for i in range(s + q, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made_text(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 60])) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(4) if words else 0):
        a = rng.randrange(len(words))
        piece, at = words[a:a + rng.randrange(1, 6)], rng.randrange(len(words) + 1)
        words[at:at] = piece * rng.randrange(2, 9)
    return words


def test_runs_of_many_texts():
    rng = random.Random(3)
    for trial in range(200):
        texts = [made_text(rng) for _ in range(rng.randrange(1, 30))]
        texts += texts[:trial % 4]  # equal texts share their nonterminals
        bounds = np.cumsum([0, *map(len, texts)])
        found = zip(*(x.tolist() for x in find_runs(np.array([w for t in texts for w in t], dtype=np.int64), bounds)))
        assert list(found) == [(s + b, e + b, q) for t, b in zip(texts, bounds.tolist()) for s, e, q in plain(t)]


def test_derivation_gives_the_text_back():
    rng = random.Random(4)
    texts = [made_text(rng) for _ in range(40)]
    words, bounds = np.array([w for t in texts for w in t], dtype=np.int64), np.cumsum([0, *map(len, texts)])
    symbol, place, length, left = derive(words, bounds, 100)
    whole = {(p, n) for p, n in zip(place.tolist(), length.tolist())}
    assert all((int(b), len(t)) in whole for t, b in zip(texts, bounds) if len(t) > 1)  # a root for each text
    said = {}
    for s, p, n, m in zip(symbol.tolist(), place.tolist(), length.tolist(), left.tolist()):
        assert said.setdefault(s, (words[p:p + n].tolist(), m)) == (words[p:p + n].tolist(), m)
        assert m == 1 or (p, m) in whole
        assert n - m == 1 or (p + m, n - m) in whole


def test_one_word_and_thue_morse():
    n = 100_000
    assert [x.tolist() for x in find_runs(np.zeros(n, np.int64), np.array([0, n]))] == [[0], [n], [1]]
    thue = np.array([bin(i).count("1") % 2 for i in range(1 << 14)])
    assert not len(find_runs(thue, np.array([0, len(thue)]))[0])  # free of cubes


def test_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "a", "a " * 6, "a " * 5, "x y " * 4, "é é é é é é", "A a " * 9, "\x1c" + " b" * 8 + "\x0b b"]
    texts += [" ".join(map(str, made_text(rng))) for _ in range(30)] + ["lorem ipsum dolor " * 40_000, "w w " * 7]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(4, texts[4], None, None), (None, "z " * 7, None, None)]
    out = periodic_runs(documents(spark, rows, extra=("start", "runs_x", "words")), keep=("doc_id", "start", "words")).collect()
    assert len(out) == len(rows) and {r.start for r in out} == {"x"}
    by = {}
    for i, t, _, _ in rows:
        words = [w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if w]
        by[i] = (len(words), [(0, len(words), 3)] if len(words) > 100_000 else [(s, e - s, q) for s, e, q in plain(words)],
                 "lorem ipsum dolor" if len(words) > 100_000 else collapsed(words))
    for r in out:
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == by[r.doc_id]
    assert periodic_runs(documents(spark, [])).count() == 0


def test_repeated_tail(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(" b  c\td\ne f g h i j k l m n o p q").alias("text"))
    for r in df.select("doc_id", repeated_tail(F.col("text"), F.col("doc_id")).alias("t")).collect():
        import zlib
        w, h = "b c d e f g h i j k l m n o p q".split(), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, 16
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r.t == " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        else:
            assert r.t.split() == w
