"""Pipeline stages on odd rows and clashing names, against plain rules; repeated words in decontamination."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brisa.llm.mixing import mixed_documents
from brisa.llm.winnow import contamination
from made import SF001, documents
from test_queries import benchmark_hits, near_groups

EXTRA = ("my col", "copies", "ranges", "score", "row", "key", "id", "component", "items", "n_hit")


def items(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def check_hits(spark, texts, benchmark, **options):
    df = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], extra=("my col",))
    out = contamination(df, items(spark, benchmark), keep=("doc_id", "my col"), **options).orderBy("doc_id").collect()
    want = list(benchmark_hits(texts, list(enumerate(benchmark))))
    assert [(r.n_words, r.n_hit, sorted(r["items"])) for r in out] == want


def test_repeated_words_are_linear(spark):
    """20 000 equal words against 20 000: one window, one entry."""
    began = time.time()
    df = documents(spark, [(1, "spam " * 20_000, "en", "s"), (2, "spam " * 9, "en", "s")])
    out = {r.doc_id: r for r in contamination(df, items(spark, ["spam " * 20_000, "ham " * 20_000])).collect()}
    assert (out[1].n_hit, out[1]["items"], out[2].n_hit) == (20_000, ["0"], 0)
    assert time.time() - began < 40


def test_passage_in_many_items(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    df = documents(spark, [(i, f"own{i} {passage} end{i}", "en", "s") for i in range(40)])
    out = contamination(df, items(spark, [f"item{i} {passage}" for i in range(5000)])).collect()
    assert all(r.n_hit == 30 and len(r["items"]) == 5000 for r in out)


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_windows_of_all_kinds(spark, block_bytes):
    w = " ".join(f"w{i}" for i in range(25))
    texts = [None, "", "short", "x short y", "a b a b a b a b a b a b a b", w, "k " * 9 + w, "w3 w4 w5", "W1 w2, w3; " + w.upper(), "no match here at all in these many words of text"]
    check_hits(spark, texts, ["short", "a b " * 8, w + " tail", "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13", "", "a b a", w], block_bytes=block_bytes)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"text number {i} of the table with some words {i * 7} and more {i}", "en", "ab"[i % 2]) for i in range(12)]
    rows += [(20, None, None, None), (21, "", "en", "a"), (22, "word " * 200_000, "en", "b"), (None, "no id but words of its own", "en", "a"), (3, rows[3][1], "en", "b")]
    return documents(spark, rows, extra=EXTRA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_takes_odd_rows_and_names(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, SF001)
    rows = out.count()
    assert 0 < rows
    if name != "token-ids":
        assert out.columns == odd.columns and out.schema.fields[1].dataType == odd.schema.fields[1].dataType
    none = stage(spark, odd.filter("false"), SF001)
    assert none.count() == 0 and none.columns == out.columns


def test_near_dedup_stage(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    _, roots = near_groups([r.text for r in rows])
    kept = sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, SF001).collect())
    assert kept == [r.doc_id for i, r in enumerate(rows) if roots[i] == i]


def test_decontamination_stage(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    clean = [r.doc_id for r, (_, hit, _) in zip(rows, benchmark_hits([r.text for r in rows], bench)) if not hit]
    assert sorted(r.doc_id for r in corpus_pipeline.decontaminated(spark, docs, SF001).collect()) == clean


def test_mixing_writes_what_it_counts(spark):
    """The words of the written rows of every document are those that the mix takes, in order."""
    from brisa.llm.mixing import mix_sources
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    plan = {r.doc_id: r for r in mix_sources(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {}
    for r in mixed_documents(docs).select("doc_id", "text", "n_chars").collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.doc_id, []).append(r.text.split())
    for i, p in plan.items():
        words, want = (texts[i] or "").split(), []
        want += [words] * p.copies
        some = [w for a in p.ranges for w in words[a["first"]:a["last"]]]
        want += [some] if some else []
        assert sorted(got.get(i, [])) == sorted(want)
        assert sum(map(len, want)) == p.taken


def test_mixing_of_a_long_text_is_linear(spark):
    began = time.time()
    rows = [(1, "word " * 400_000, "en", "a"), (2, "other " * 40, "en", "b")]
    out = mixed_documents(documents(spark, rows)).select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0]
    assert out > 0 and time.time() - began < 60


def test_seats_up_to_the_caps():
    import numpy as np
    from brisa.llm.mixing import sainte_lague
    assert sainte_lague(np.array([1]), 3, np.array([3])).tolist() == [3]
    assert sainte_lague(np.array([1.0, 2.0]), 50, np.array([3, 6])).tolist() == [3, 6]
    for weights, seats, caps in (([5, 3, 1], 9, [9, 9, 9]), ([1, 1, 1], 2, [1, 1, 1]), ([10, 1], 7, [3, 9]), ([0, 4], 3, [5, 5])):
        given = [0] * len(weights)
        for _ in range(seats):  # by highest quotients, the first of equal ones
            i = max((i for i in range(len(weights)) if given[i] < caps[i] and weights[i]), key=lambda i: (weights[i] / (2 * given[i] + 1), -i), default=None)
            if i is not None:
                given[i] += 1
        assert sainte_lague(np.array(weights), seats, np.array(caps)).tolist() == given
