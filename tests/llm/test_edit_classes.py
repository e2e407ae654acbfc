"""Classes of near copies against the edit distance of whole texts."""

import random

from brisa.llm.editwalk import _by_diagonals, edit_distance, with_classes
from made import SF001, documents
import numpy as np


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé\U0001F600") for _ in range(rng.randrange(12))) for _ in "ab")
        want = plain(a, b)
        for most in (0, 1, 3, 12):
            got = edit_distance(a, b, most)
            assert got == (want if want <= most else None), (a, b, most)
            x, y = (np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in (a, b))
            assert _by_diagonals(x, y, most) == (want if want <= most else None), (a, b, most)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_near_copies_that_are_no_neighbours(spark):
    rng = random.Random(5)
    base, other = words(rng, 400), words(rng, 2500)
    rows = [(1, base, "en", "a"), (5, words(rng, 400), "en", "a"), (9, base[:700] + "X" + base[705:], "en", "a"), (12, other, "en", "a"),
            (14, words(rng, 300), "en", "a"), (20, other[:9000] + other[9040:], "en", "a"), (21, base, "en", "a"),
            (30, base[:900] + words(rng, 250), "en", "a"), (None, base, "en", "a"), (40, "", "en", "a"), (41, None, "en", "a")]
    got = {r.doc_id: r.class_id for r in with_classes(documents(spark, rows, ["class_id", "id"])).collect()}
    assert got == {1: 1, 5: 5, 9: 1, 12: 12, 14: 14, 20: 12, 21: 1, 30: 30, None: 1, 40: 40, 41: 40}


def test_hot_bucket_of_unlike_texts(spark):
    rng = random.Random(6)
    start = words(rng, 150)
    rows = [(i, start + words(rng, 150), "en", "a") for i in range(40)]
    rows += [(100 + i, t[:-3] + "!!!", la, so) for i, t, la, so in rows]
    got = {r.doc_id: r.class_id for r in with_classes(documents(spark, rows)).collect()}
    assert got == {i: i % 100 for i in got}


def test_smallest_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = sorted((r.class_id, r.doc_id) for r in with_classes(docs).collect())
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(out) == len(text)
    classes = {}
    for c, i in out:
        classes.setdefault(c, []).append(i)
    for c, ids in classes.items():  # every class hangs together by true links
        reached, left = {c}, set(ids) - {c}
        while left:
            new = {i for i in left if any(edit_distance(text[i], text[j], max(len(text[i]), len(text[j])) // 10) is not None for j in reached)}
            assert new, (c, left)
            reached, left = reached | new, left - new
