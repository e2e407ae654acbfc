"""Benchmarks of several blocks, and several benchmarks in one session."""

from types import SimpleNamespace

from brisa.llm.winnow import _block, contamination
from made import documents


def test_cache_holds_what_it_was_asked_for():
    for k in range(200):  # the freed list's address often comes back
        block = _block(SimpleNamespace(value=[(str(k), f"a b c d e {k}")]), 10, 5)
        assert block.ids == [str(k)]
    items = SimpleNamespace(value=[("x", "a b c d e f g h i j k l")])
    assert (_block(items, 10, 5).span, _block(items, 6, 3).span, _block(items, 6, 2).gram) == (10, 6, 2)
    assert _block(items, 6, 2) is _block(items, 6, 2)


def test_small_blocks_and_two_benchmarks(spark):
    item = {i: " ".join(f"w{i}x{j}" for j in range(12)) for i in range(8)}
    docs = documents(spark, [(i, f"before {item[i]} after", "en", "a") for i in range(8)] + [(9, "none of it", "en", "a")])
    both = []
    for ids in (range(8), range(0, 8, 2), range(1, 8, 2)):
        bench = spark.createDataFrame([(str(i), item[i]) for i in ids], "item_id string, text string")
        got = {r.doc_id: (r.n_hit, list(r["items"])) for r in contamination(docs, bench, block_bytes=1).collect()}
        assert got == {i: (12, [str(i)]) if i in ids else (0, []) for i in (*range(8), 9)}
        both.append(got)
    assert both[1] != both[2]
