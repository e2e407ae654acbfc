"""Near-duplicate groups by circulant MinHash.

Two permutations of ``0 .. D-1`` are shared by all documents: the first spreads
the shingles, the second, shifted circularly by k, gives the k-th coordinate.
All coordinates of one shingle are one contiguous slice of the second
permutation, so a signature is a minimum over gathered rows.  Signatures are
banded and documents that meet in a band are candidates, which are confirmed on the full
shingle sets.

Before any pair is made, the shingles that a document of a band group's buckets shares with any
other one there are counted, in parts of the hash range.  Two documents share at most the
sum of the smaller counts, so the similarity is bounded from above without error: a pair
whose bound is too low is not made, and a document with too few of them leaves the buckets.
Members of a large group that differ in their own ways are not compared with all of it.

Equal sets are one class with one representative.  Bands are taken in a few groups.
In a group the smallest members of a bucket (the centers) are compared with its members of
other components; linked classes are merged; buckets whose remaining members all
belong to one component are done, the others go on without their centers.  A
cluster that the first group has joined is one component and no work for the later ones.  A
pair is looked at in its first common band only.  So every candidate pair is
either compared or already connected, and no round emits all pairs of a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import passing_scratch, shared_path
from .batches import NON_SPACE, chunks, flat_text, gram_hashes, list_array, mix64, small_batches, stage, word_bounds, word_hashes

SHINGLE = 5
#: a pair of similarity 0.75 meets in no band with probability (1 - 0.75^6)^56 = 1.7e-5; documents that share
#: a passage of a fifth of their shingles meet in 0.4 % of the cases (bands of 4 rows: 8 % of them in 32 bands)
BANDS, ROWS = 56, 6
#: bands of the first group; it joins nearly all near copies (at 0.75 two thirds of the pairs, at 0.9 99 %)
FIRST_GROUP = 6
#: parts of the hash range in which shared shingles are counted (any number gives the same links)
PARTS = 16
#: members of a bucket that are compared with all others in a round (after the first one, which takes one)
CENTERS = 512
#: ids that are sent to all tasks to pick their texts; more are joined
SENT_IDS = 2_000_000
UNIVERSE = 1 << 20


class Circulant:
    """The two permutations and the signatures they give."""

    def __init__(self, coordinates: int, universe: int = UNIVERSE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k, self.universe = coordinates, universe
        self.spread = rng.permutation(universe).astype(np.uint32)
        second = rng.permutation(universe).astype(np.uint32)
        self.slices = np.lib.stride_tricks.sliding_window_view(
            np.concatenate([second, second[:coordinates - 1]]), coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Minimum of each shifted permutation over the shingles (at least one)."""
        at = self.spread[(shingles & np.uint64(self.universe - 1)).astype(np.int64)]
        out = self.slices[at[:1024]].min(axis=0)
        for i in range(1024, len(at), 1024):
            np.minimum(out, self.slices[at[i:i + 1024]].min(axis=0), out=out)
        return out


def shingle_sets(flat: np.ndarray, offs: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    starts, ends, words = word_bounds(flat, offs, NON_SPACE)
    hashes = word_hashes(flat, starts, ends)
    grams = gram_hashes(hashes, width)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
        if b - a >= width:
            s = np.sort(grams[a:b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(gram_hashes(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


_SIGNER: dict[tuple, Circulant] = {}


def _signer(coordinates: int, seed: int) -> Circulant:
    key = (coordinates, seed)
    if key not in _SIGNER:
        _SIGNER[key] = Circulant(coordinates, seed=seed)
    return _SIGNER[key]


def signatures(docs: DataFrame, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """doc_id, n_shingles, cls (digest of the shingle set, null if empty), bands (hashes), packed (the compressed text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, pack = _signer(bands * rows, seed), zstandard.ZstdCompressor().compress
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(*flat_text(part.column("text")), width)
                full = [s for s in sets if len(s)]
                keys = np.empty((len(full), bands), dtype=np.uint64)
                for i, s in enumerate(full):
                    sig = signer.signature(s).astype(np.uint64).reshape(bands, rows)
                    h = salt.copy()
                    for j in range(rows):
                        h = mix64(h + sig[:, j])
                    keys[i] = h
                digests = iter([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in full])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([next(digests) if len(s) else None for s in sets], type=pa.binary()),
                    list_array(keys.ravel().view(np.int64), np.array([bands if len(s) else 0 for s in sets]), pa.int64()),
                    pa.array([pack(t) if len(s) else None for s, t in zip(sets, part.column("text").cast(pa.binary()).to_pylist())], type=pa.binary()),
                ], names=["doc_id", "n_shingles", "cls", "bands", "packed"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_shingles long, cls binary, bands array<long>, packed binary"))


def _unpacked_sets(packed: list[bytes], width: int) -> dict[bytes, np.ndarray]:
    """The shingle set of each compressed text."""
    unpack = zstandard.ZstdDecompressor().decompress
    packed = list(dict.fromkeys(packed))
    texts = pa.array([unpack(p) for p in packed], type=pa.large_binary()).cast(pa.large_string())
    return dict(zip(packed, shingle_sets(*flat_text(texts), width)))


def _linked(pairs: DataFrame, packed: DataFrame, percent: int, width: int, pairs_at_once: int = 256) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, pairs_at_once):
                batch = whole.slice(at, pairs_at_once)
                a, b, keep = batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), []
                sets = _unpacked_sets(a + b, width)
                for i, (x, y) in enumerate(zip(map(sets.get, a), map(sets.get, b))):
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        keep.append(i)
                if keep:
                    keep = pa.array(keep)
                    yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return (pairs.join(packed.select(F.col("id").alias("a"), F.col("packed").alias("pa")), "a")
            .join(packed.select(F.col("id").alias("b"), F.col("packed").alias("pb")), "b")
            .select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long").distinct())


def _shareable(texts: DataFrame, width: int) -> DataFrame:
    """(id, parts): for each text (id, packed) how many distinct shingles are in another one too, by part of the hash range."""
    def sets_of(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            plain = pa.array([unpack(p) for p in batch.column("packed").to_pylist()], type=pa.large_binary()).cast(pa.large_string())
            for part in chunks(pa.RecordBatch.from_arrays([batch.column("id"), plain], names=["id", "text"]), "text"):
                yield part.column("id"), shingle_sets(*flat_text(part.column("text")), width)

    def one_by_one(batches):
        for ids, sets in sets_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids.to_numpy(), [len(s) for s in sets]), type=pa.int64()),
                                              pa.array(np.concatenate(sets).view(np.int64))], names=["id", "shingle"])

    def counted(batches):
        for ids, sets in sets_of(batches):
            found = np.concatenate([np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) for s in sets])
            yield pa.RecordBatch.from_arrays([ids, list_array(found, np.full(len(sets), PARTS), pa.int32())], names=["id", "parts"])

    holders = texts.mapInArrow(one_by_one, "id long, shingle long").groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    part = F.col("shingle").bitwiseAND(F.lit(PARTS - 1))
    own = (holders.filter("id = other").groupBy("id")
           .agg(F.array(*[F.count(F.when(part == i, 1)).cast("int") for i in range(PARTS)]).alias("own")))
    return (texts.mapInArrow(counted, "id long, parts array<int>").join(own, "id", "left")
            .select("id", F.when(F.col("own").isNull(), F.col("parts")).otherwise(F.zip_with("parts", "own", lambda a, b: a - b)).alias("parts")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b), for every id in them.

    Every node takes the smallest label among its neighbours, then the label of
    that label (pointer jumping), until nothing changes; one written table per step.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "cc-labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("cb").alias("cb")))
        low = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "cb").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        step = stage(low.join(jump, "mid").select("id", "old", F.least("mid", "far").alias("component")), "cc-step")
        labels = step.select("id", "component")
        if step.filter("component < old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = SHINGLE, bands: int = BANDS,
                    rows: int = ROWS, seed: int = 7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * shared shingles >= percent * distinct shingles
    of both; a component's id is its smallest doc_id.  Null or wordless texts have an
    empty set, are linked with nothing and are kept.  Rows of one doc_id are one
    document.  A row whose doc_id is null is linked with nothing, has a null
    component_id and is kept.  Columns other than doc_id and text are ignored.

    The result is written; all other intermediate tables are gone when this returns.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "minhash-result")
    with passing_scratch(spark), small_batches(spark):
        _near_duplicates(docs, percent, width, bands, rows, seed).write.parquet(path)
    return spark.read.schema("doc_id long, n_shingles long, component_id long, kept boolean").parquet(path)


def _near_duplicates(docs: DataFrame, percent: int, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    spark = docs.sparkSession
    signed = stage(signatures(docs, width, bands, rows, seed), "minhash-signatures")
    real = signed.filter("cls is not null and doc_id is not null")
    classes = stage(real.groupBy("cls").agg(F.min("doc_id").alias("id"), F.first("n_shingles").cast("int").alias("n"),
                                            F.first("bands").alias("bands")), "minhash-classes")
    # the same doc_id can have several texts: its classes belong together
    several = real.groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo != hi").select("doc_id")
    owned = real.select("doc_id", "cls").join(several, "doc_id").join(classes.select("cls", "id"), "cls").select("doc_id", "id").distinct()
    edges = stage(owned.join(owned.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").filter("a != id").select("a", F.col("id").alias("b")).distinct(), "minhash-edges")
    labels = None if edges.isEmpty() else components(edges)
    if labels is None:
        labels = spark.createDataFrame([], "id long, component long")
    cuts = [0, FIRST_GROUP, bands] if bands > FIRST_GROUP else [0, bands]
    for lo, hi in zip(cuts, cuts[1:]):
        # labels join the classes, not their bands
        members = (classes.select("id", F.slice("bands", lo + 1, hi - lo).alias("bands")).join(labels, "id", "left")
                   .select(F.explode("bands").alias("key"), "id", F.coalesce("component", "id").alias("component")))
        members = stage(_mixed(members), "minhash-buckets")
        ids = stage(members.select("id").distinct(), "minhash-ids")
        few = ids.count() <= SENT_IDS
        ids = F.broadcast(ids) if few else ids
        # any text of the first document of a class that has its set will do
        owners = classes.join(ids, "id", "left_semi").select("cls", F.col("id").alias("doc_id"))
        texts = signed.select("doc_id", "cls", "packed").join(F.broadcast(owners) if few else owners, ["doc_id", "cls"])
        texts = stage(texts.groupBy(F.col("doc_id").alias("id"), "cls").agg(F.first("packed").alias("packed")).select("id", "packed"), "minhash-texts")
        # early: the bands before this group; a pair that met there was compared, or joined on the way
        about = (classes.join(_shareable(texts, width), "id")
                 .withColumn("most", F.aggregate("parts", F.lit(0), lambda t, v: t + v)).filter(100 * F.col("most") >= percent * F.col("n"))
                 .select("id", F.struct("n", "most", *[F.col("parts")[i].alias(f"p{i}") for i in range(PARTS)],
                                        *[F.col("bands")[i].alias(f"early{i}") for i in range(lo)]).alias("about")))
        members = stage(_mixed(members.join(stage(about, "minhash-about"), "id")), "minhash-buckets")
        centers = 1
        while not members.isEmpty():
            if centers == 1:
                first = members.groupBy("key").agg(F.min_by(F.struct("id", "component", "about"), "id").alias("c")).select("key", "c.*")
            else:
                first = members.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("r") <= centers).drop("r")
            first = first.select("key", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("about").alias("of_a"))
            new = reduce(Column.__and__, [F.col(f"about.early{i}") != F.col(f"of_a.early{i}") for i in range(lo)], F.lit(True))
            pairs = (members.join(first, (members["key"] == first["key"]) & (F.col("a") < F.col("id")) & (F.col("ca") != F.col("component"))
                                  & new & _may_link("about", "of_a", percent))
                     .select("a", F.col("id").alias("b")).distinct())
            pairs = stage(pairs, "minhash-pairs")
            links = stage(_linked(pairs, texts, percent, width), "minhash-links")
            found = not links.isEmpty()
            if found:
                edges = edges.union(links)
                labels = components(edges)
            rest = members.join(first.select("key", F.col("a").alias("id")), ["key", "id"], "left_anti")
            if found:
                rest = rest.drop("component").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
            members = stage(_mixed(rest), "minhash-buckets")
            centers = CENTERS
    of_class = classes.select("cls", "id").join(labels, "id", "left").select("cls", F.coalesce("component", "id").alias("component"))
    of_doc = real.select("doc_id", "cls").join(of_class, "cls").groupBy("doc_id").agg(F.min("component").alias("component"))
    return (signed.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether two documents (columns of n, most and parts) can be similar enough; never false for a link."""
    def low(name: str) -> Column:
        return F.least(f"{x}.{name}", f"{y}.{name}").cast("long")

    n = F.col(f"{x}.n").cast("long") + F.col(f"{y}.n")
    both = reduce(Column.__add__, [low(f"p{i}") for i in range(PARTS)])
    return ((100 * low("n") >= percent * F.greatest(f"{x}.n", f"{y}.n").cast("long"))
            & ((100 + percent) * low("most") >= percent * n) & ((100 + percent) * both >= percent * n))


def _mixed(members: DataFrame) -> DataFrame:
    """The rows (key, id, component, ...) of buckets that hold more than one component."""
    keys = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    return members.join(keys, "key").select(*members.columns)
