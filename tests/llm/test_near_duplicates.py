"""Near-duplicate groups: hashes that do not collide by construction, hot buckets, odd rows, links at the threshold."""

import random

import numpy as np

from brisa.llm import minhash
from brisa.llm.batches import NON_SPACE, flat_text, word_bounds, word_hashes
from brisa.llm.minhash import near_duplicates
from made import documents
from test_queries import near_groups


def test_thue_morse_words_differ():
    import pyarrow as pa
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = "".join("ba"[bin(i).count("1") % 2] for i in range(4096))
    flat, offs = flat_text(pa.array([one, other, one.upper(), "x" * 100 + " " + one]))
    starts, ends, _ = word_bounds(flat, offs, NON_SPACE)
    a, b, c, _, d = word_hashes(flat, starts, ends).tolist()
    assert a != b and a == c == d


def groups_of(spark, rows, **options):
    out = near_duplicates(documents(spark, rows, extra=("key", "id", "component", "bands")), **options).toPandas()
    return out.sort_values("doc_id", ignore_index=True)


def test_hot_passage_and_near_copies(spark):
    """Documents that share a passage, a chain of near copies and exact copies, against all pairs."""
    rng = random.Random(2)
    word = lambda: "w" + str(rng.randrange(100_000))
    passage, base = [word() for _ in range(60)], [word() for _ in range(150)]
    texts = []
    for _ in range(120):
        own = [word() for _ in range(rng.randrange(10, 200))]
        at = rng.randrange(len(own))
        texts.append(own[:at] + passage + own[at:])
    for _ in range(120):  # similarities around the threshold
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    rows = [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]
    out = groups_of(spark, rows)
    sizes, roots = near_groups([t for _, t, _, _ in rows])
    assert out.n_shingles.tolist() == sizes and out.component_id.tolist() == roots


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(3, None, "en", "s"), (4, "", "en", "s"), (5, "one two", "en", "s"), (2, "ONE  two", "en", "s"), (6, long, "en", "s"), (7, long + " end", "en", "s"),
            (8, "a b c d e f", None, None), (8, "q r s t u v", None, None), (9, "q r s t u v", None, None), (1, "a b c d e f", None, None), (None, "a b c d e f", None, None)]
    out = near_duplicates(documents(spark, rows)).toPandas()
    got = {(None if np.isnan(r.doc_id) else int(r.doc_id)): (None if np.isnan(r.component_id) else int(r.component_id), r.kept) for r in out.itertuples()}
    assert got == {3: (3, True), 4: (4, True), 5: (2, False), 2: (2, True), 6: (6, True), 7: (6, False), 8: (1, False), 9: (1, False), 1: (1, True), None: (None, True)}
    assert near_duplicates(documents(spark, [])).count() == 0


def test_recall_at_the_threshold():
    """Sets of similarity 0.75 exactly meet in a band, as computed for independent coordinates."""
    rng = np.random.default_rng(3)
    signer = minhash.Circulant(minhash.BANDS * minhash.ROWS)
    met = 0
    for _ in range(3000):
        s = rng.integers(0, 1 << 63, 160, dtype=np.uint64)  # 120 shared, 20 of each own: 120 / 160
        same = signer.signature(s[:140]) == signer.signature(np.concatenate([s[:120], s[140:]]))
        met += same.reshape(minhash.BANDS, minhash.ROWS).all(axis=1).any()
    assert met >= 2998


def test_bound_never_drops_a_link(spark):
    """The counts of shareable shingles against sets: a pair that may not link has a similarity below the threshold."""
    import zstandard
    from pyspark.sql import functions as F
    rng = random.Random(7)
    base = ["w" + str(i) for i in range(80)]
    texts = [" ".join(base[rng.randrange(20):] + ["x" + str(rng.randrange(40)) for _ in range(rng.randrange(25))]) for _ in range(80)] + ["one two"]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    packed = spark.createDataFrame([(i, bytearray(zstandard.ZstdCompressor().compress(t.encode()))) for i, t in enumerate(texts)], "id long, packed binary")
    got = {r.id: r.parts for r in minhash._shareable(packed, 5).collect()}
    for i, s in enumerate(sets):
        assert sum(got[i]) == len(s & set().union(*(t for j, t in enumerate(sets) if j != i)))
    rows = [(i, j, *[(len(sets[k]), sum(got[k]), *got[k]) for k in (i, j)], 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
            for i in range(len(sets)) for j in range(i)]
    kind = "struct<n int, most int, " + ", ".join(f"p{i} int" for i in range(minhash.PARTS)) + ">"
    pairs = spark.createDataFrame(rows, f"a int, b int, x {kind}, y {kind}, link boolean").withColumn("may", minhash._may_link("x", "y", 75))
    told = {(r.link, r.may): r.n for r in pairs.groupBy("link", "may").agg(F.count("*").alias("n")).collect()}
    assert told.get((True, False), 0) == 0 and told[(True, True)] > 20 and told[(False, False)] > 20
