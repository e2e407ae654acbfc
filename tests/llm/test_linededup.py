"""Line index against plain counting, through insertions and deletions."""

import random
from collections import defaultdict

import numpy as np
import pytest

from brisa.llm.linededup import CuckooFilter, LineIndex
from brisa.session import shared_path
from made import documents

SPACE = " \t\n\v\f\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(FOLD)


def plain(held, rows, least_docs=3, least_chars=20):
    """(id, n_lines, n_dropped, kept) of the rows against the held (id, text)."""
    where = defaultdict(set)
    for i, t in held:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                where[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(where[key(x)]) < least_docs or max(where[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=repr)


def frame(spark, rows):
    return documents(spark, [(i, t, "en", "s") for i, t in rows])


def made_rows(rng, ids, lines):
    return [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))) for i in ids]


POOL = [f"{c} shared line number {n} of the pool" for n in range(12) for c in ("The", "\t tHe", "the")] + ["short", "", " ", "exactly twenty chars", "éxactly twenty chars", "exactly nineteen ch"]


def test_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    held = CuckooFilter.sized(len(keys))
    assert held.add(keys) and held.holds(keys).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert held.holds(others).mean() < 0.005
    held.remove(keys[::2])
    assert held.holds(keys[1::2]).all() and held.holds(keys[::2]).mean() < 0.01
    again = CuckooFilter.of_bytes(bytes(held))
    assert again.add(keys[::2]) and again.holds(keys).all()
    again.remove(keys)
    assert not again.table.any()
    assert not CuckooFilter.sized(4).add(keys)


def test_insert_delete_and_reload(spark):
    rng = random.Random(7)
    path = shared_path(spark, "test-line-index")
    first, more = made_rows(rng, range(30), POOL), made_rows(rng, range(100, 130), POOL)
    first += [(5, first[5][1]), (None, POOL[0]), (31, None), (32, POOL[0] + "\n" + POOL[1] + "\n" + "unique line that stays")]
    index = LineIndex(path, shards=4).insert(frame(spark, first))
    assert rows_of(index.apply(frame(spark, first))) == plain(first, first)
    two = index.insert(frame(spark, more + first[:3]))  # three again: nothing is counted twice
    assert rows_of(two.apply(frame(spark, first + more))) == plain(first + more, first + more)
    gone = spark.createDataFrame([(i,) for i in [*range(100, 130, 2), 32, 999, None]], "doc_id long")
    left = [(i, t) for i, t in first + more if i != 32 and not (i is not None and i >= 100 and i % 2 == 0)]
    three = two.delete(gone)
    assert rows_of(three.apply(frame(spark, first + more))) == plain(left, first + more)
    # all of the second part out: as after the first part, filters included
    back = three.insert(frame(spark, first)).delete(spark.createDataFrame([(i,) for i in range(100, 130)], "doc_id long"))
    assert rows_of(back.apply(frame(spark, first))) == plain(first, first)
    count = lambda i: sorted((bytes(r.key), r.docs, r.last) for r in i.counted(spark).collect())
    assert count(back) == count(index)
    size = lambda i: sum(np.count_nonzero(np.frombuffer(bytes(r.filter), np.uint16)) for r in i.screened(spark).collect())
    assert size(back) == size(index) == sum(n >= 3 for _, n, _ in count(index))
    # earlier versions stay readable; the newest is found again; one segment says the same
    assert rows_of(two.apply(frame(spark, more))) == plain(first + more, more)
    assert LineIndex.load(spark, path) == back
    small = back.compact(spark)
    assert len(small.references) == len(small.counts) == len(small.filters) == 1 and count(small) == count(back)
    assert rows_of(small.apply(frame(spark, first))) == plain(first, first)


@pytest.mark.parametrize("shards", [1, 3])
def test_filters_grow_and_keys_join(spark, shards):
    rng = random.Random(8)
    lines = [f"a line of some length, number {n}" for n in range(400)]
    first = [(i, "\n".join(lines[:8])) for i in range(4)]
    more = made_rows(rng, range(10, 40), lines) + [(i, "\n".join(lines)) for i in (50, 51, 52)] + [(None, lines[0]), (60, "x" * 1_000_000 + "\n" + lines[1])]
    index = LineIndex(shared_path(spark, "test-line-index"), shards=shards).insert(frame(spark, first)).insert(frame(spark, more))
    want = plain(first + more, first + more)
    assert rows_of(index.apply(frame(spark, first + more))) == want
    assert rows_of(index.apply(frame(spark, first + more), small_bytes=0)) == want  # no table is sent to the tasks
    assert rows_of(index.apply(frame(spark, first + more), small_bytes=6000)) == want  # the filters only


def test_empty_and_clashing_names(spark):
    index = LineIndex(shared_path(spark, "test-line-index"), shards=2)
    none = documents(spark, [])
    assert index.apply(none).count() == 0 and index.insert(none).apply(none).count() == 0
    rows = documents(spark, [(i, POOL[0], "en", "s") for i in range(4)], extra=("key", "last", "shard", "docs"))
    full = index.insert(rows)
    for small in (1 << 20, 0):
        out = full.apply(rows, keep=("doc_id", "key", "last", "shard", "docs"), small_bytes=small).collect()
        assert sorted((r.doc_id, r.n_dropped, r.key, r.docs) for r in out) == [(0, 1, "x", "x"), (1, 1, "x", "x"), (2, 1, "x", "x"), (3, 0, "x", "x")]
