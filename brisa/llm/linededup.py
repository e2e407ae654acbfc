"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

An index holds three kinds of tables in a shared folder, each as segments that an
update adds and never changes:

* references: which document holds which key, signed (+1 inserted, -1 deleted);
* counts: for every touched key its exact number of documents and the largest of them;
* filters: for every touched shard a cuckoo filter of the keys that enough documents
  hold.  Keys enter it when their count rises to the bound and leave it when it falls
  below, so a deleted document takes its effect back.

A line that its shard's filter does not know stays without another look; the others are
confirmed by the exact counts.  Filters that no longer fit are rebuilt larger from
the counts.  An update shows once its manifest is written, so a job that is lost
half-way changes nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import chunks, mix64, with_fields

LEAST_DOCS, LEAST_CHARS, SHARDS = 3, 20, 64
#: bytes of filters, and of confirmed keys, up to which they are sent to the tasks that read the texts
SMALL_BYTES = 64 << 20
#: keys that hold at least one in so many references of a table are joined apart (at most so many keys)
HOT_SHARE = 10_000
SLOTS, KICKS = 4, 500
SPACE = " \t\n\v\f\r"

REFERENCES = "key binary, doc_id long, sign int"
COUNTS = "shard int, key binary, docs long, last long, version int"
FILTERS = "shard int, filter binary, version int"


class CuckooFilter:
    """A set of 64-bit hashes by 16-bit fingerprints, each in one of two buckets of four slots."""

    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, slots); 0 is free

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def of_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def __bytes__(self) -> bytes:
        return self.table.tobytes()

    def _print(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(48)).astype(np.uint16) | np.uint16(1)

    def _buckets(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        one = hashes & mask
        return one, (one ^ mix64(self._print(hashes).astype(np.uint64))) & mask

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be in the set (always true if it is)."""
        (one, two), mark = self._buckets(hashes), self._print(hashes)[:, None]
        return (self.table[one] == mark).any(axis=1) | (self.table[two] == mark).any(axis=1)

    def remove(self, hashes: np.ndarray) -> None:
        """Take out hashes that are in the set."""
        (one, two), mark = self._buckets(hashes), self._print(hashes)
        for a, b, f in zip(one.tolist(), two.tolist(), mark.tolist()):
            row = a if f in self.table[a] else b
            self.table[row, self.table[row].tolist().index(f)] = 0

    def add(self, hashes: np.ndarray) -> bool:
        """Put in hashes that are not in the set; False if one found no place (the filter is then of no use)."""
        (one, two), mark = self._buckets(hashes), self._print(hashes)
        table, mask = self.table, len(self.table) - 1
        for a, b, f in zip(one.tolist(), two.tolist(), mark.tolist()):
            at = a if 0 in table[a] else b
            for kick in range(KICKS):
                row = table[at].tolist()
                if 0 in row:
                    table[at, row.index(0)] = f
                    break
                f, table[at, kick % SLOTS] = row[kick % SLOTS], f
                at = (at ^ int(mix64(np.array([f], dtype=np.uint64))[0])) & mask
            else:
                return False
        return True


def _hash64(keys: pa.Array) -> np.ndarray:
    """The first 8 bytes of 16-byte keys."""
    return np.frombuffer(b"".join(keys.to_pylist()), dtype="<u8")[::2]


def _fixed(keys: pa.Array) -> np.ndarray:
    """Keys as 16-byte strings that numpy can search."""
    return np.frombuffer(b"".join(keys.to_pylist()), dtype="S16")


class Lines:
    """The lines of a slice of texts: raw, their offsets by text, and which are long enough, with their keys."""

    def __init__(self, texts: pa.Array, least_chars: int):
        lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
        self.raw = pc.list_flatten(lists)
        self.offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
        folded = pc.ascii_lower(pc.ascii_trim(self.raw, characters=SPACE))
        self.long = np.flatnonzero(pc.greater_equal(pc.utf8_length(folded), least_chars).to_numpy(zero_copy_only=False))
        texts = folded.take(pa.array(self.long)).cast(pa.large_binary()).to_pylist()
        self.keys = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], type=pa.binary(16))
        self.row = np.searchsorted(self.offsets, self.long, "right") - 1


def _references(docs: DataFrame, least_chars: int) -> DataFrame:
    """The distinct (key, doc_id) of the documents with an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                lines = Lines(part.column("text"), least_chars)
                yield pa.RecordBatch.from_arrays([lines.keys.cast(pa.binary()), part.column("doc_id").take(pa.array(lines.row))],
                                                 names=["key", "doc_id"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .filter("doc_id is not null").mapInArrow(run, "key binary, doc_id long").distinct())


def _shard(key, shards: int):
    return F.pmod(F.conv(F.hex(F.substring(key, 13, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _updated_filters(filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) of the shards that ``changes`` (shard, key, enters) touches; a null filter did not fit.

    Every shard is one run of rows: first its filter, then the keys that leave, then those that enter.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, touched = None, None, False

        def done():
            if touched:
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([held and bytes(held)], pa.binary())],
                                                 names=["shard", "filter"])

        for batch in batches:
            at, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (kinds[1:] != kinds[:-1])])) if len(at) else []
            for a, z in zip(cuts, [*cuts[1:], len(at)]):
                if at[a] != shard:
                    yield from done()
                    shard, held, touched = int(at[a]), CuckooFilter.sized(int(batch.column("size")[a].as_py())), False
                body = batch.column("body").slice(a, z - a)
                if kinds[a] == 0:
                    held = CuckooFilter.of_bytes(body[0].as_py())
                    continue
                touched = True
                if held is not None and kinds[a] == 1:
                    held.remove(_hash64(body))
                elif held is not None and not held.add(_hash64(body)):
                    held = None
        yield from done()

    size = changes.groupBy("shard").agg(F.count_if("enters").alias("size"))
    rows = (filters.select("shard", F.lit(0).alias("kind"), F.col("filter").alias("body"))
            .unionByName(changes.select("shard", F.when(F.col("enters"), 2).otherwise(1).alias("kind"), F.col("key").alias("body"))))
    return (rows.join(F.broadcast(size), "shard")  # one row per shard
            .repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "shard int, filter binary"))


@dataclass(frozen=True)
class LineIndex:
    """A version of the index; updates return the next one and leave this one readable.

    A line's key is the line with ASCII white space stripped at both ends and A-Z
    lower-cased, and counts if it has ``least_chars`` code points.  Rows of one doc_id are one
    document, null texts are one empty line.  Rows without doc_id hold no references.
    """
    path: str
    references: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()
    version: int = 0
    shards: int = SHARDS
    least_docs: int = LEAST_DOCS
    least_chars: int = LEAST_CHARS

    # ---- tables

    def _segments(self, spark: SparkSession, paths: tuple[str, ...], schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def held(self, spark: SparkSession) -> DataFrame:
        """The (key, doc_id) that the index holds now."""
        rows = self._segments(spark, self.references, REFERENCES)
        if len(self.references) < 2:
            return rows.select("key", "doc_id")
        return rows.groupBy("key", "doc_id").agg(F.sum("sign").alias("n")).filter("n > 0").select("key", "doc_id")

    def _newest(self, spark: SparkSession, paths: tuple[str, ...], schema: str, by: str) -> DataFrame:
        rows = self._segments(spark, paths, schema)
        if len(paths) < 2:
            return rows
        rest = [c for c in rows.columns if c != by]
        return rows.groupBy(by).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(by, "r.*")

    def counted(self, spark: SparkSession) -> DataFrame:
        """shard, key, docs, last: the exact number of documents of every key and the largest of them."""
        return self._newest(spark, self.counts, COUNTS, "key").filter("docs > 0").select("shard", "key", "docs", "last")

    def screened(self, spark: SparkSession) -> DataFrame:
        """shard, filter: the cuckoo filter of every shard that has one."""
        return self._newest(spark, self.filters, FILTERS, "shard").select("shard", "filter")

    # ---- updates

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the lines of ``docs`` (doc_id, text) added; what it holds already is not counted twice."""
        spark = docs.sparkSession
        new = _references(docs, self.least_chars)
        if self.references:
            new = new.join(self.held(spark), ["key", "doc_id"], "left_anti")
        return self._update(spark, new.withColumn("sign", F.lit(1)))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents whose doc_id is in ``ids``; unknown ids change nothing."""
        spark = ids.sparkSession
        gone = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        return self._update(spark, self.held(spark).join(gone, "doc_id", "left_semi").select("key", "doc_id", F.lit(-1).alias("sign")))

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}/v{self.version + 1}"
        df.write.mode("overwrite").parquet(path)  # a repeated update writes the same again
        return path

    def _update(self, spark: SparkSession, changes: DataFrame) -> LineIndex:
        after = replace(self, references=(*self.references, self._write(changes, "references")), version=self.version + 1)
        changes = spark.read.schema(REFERENCES).parquet(after.references[-1])
        delta = changes.groupBy("key").agg(F.sum("sign").alias("delta"), F.max("doc_id").alias("top"), F.min("sign").alias("low"))
        if self.counts:
            delta = delta.join(self.counted(spark).select("key", "docs", "last"), "key", "left")
        else:
            delta = delta.withColumns({"docs": F.lit(0).cast("long"), "last": F.lit(None).cast("long")})
        was = F.coalesce("docs", F.lit(0))
        delta = delta.select("key", was.alias("was"), (was + F.col("delta")).alias("docs"),
                             F.when(F.col("low") > 0, F.greatest("last", "top")).alias("last"))  # null: to be found again
        if self.references:
            # a key may have lost its largest document: the largest of those that are left
            lost = delta.filter("last is null and docs > 0").select("key")
            found = after.held(spark).join(lost, "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("found"))
            delta = delta.join(found, "key", "left").withColumn("last", F.coalesce("last", "found")).drop("found")
        delta = delta.select(_shard(F.col("key"), self.shards).alias("shard"), "key", "docs", "last", F.lit(after.version).alias("version"), "was")
        counts = self._write(delta, "counts")
        after = replace(after, counts=(*self.counts, counts))
        moved = (spark.read.schema(COUNTS + ", was long").parquet(counts)
                 .filter(f"(was >= {self.least_docs}) != (docs >= {self.least_docs})")
                 .select("shard", "key", (F.col("docs") >= self.least_docs).alias("enters")))
        fresh = self._write(_updated_filters(self.screened(spark), moved, self.shards), "filters-tried")
        fresh = spark.read.schema("shard int, filter binary").parquet(fresh)
        full = fresh.filter("filter is null").select("shard")
        again = (after.counted(spark).filter(f"docs >= {self.least_docs}").join(F.broadcast(full), "shard", "left_semi")  # one row per shard
                 .select("shard", "key", F.lit(True).alias("enters")))
        empty = spark.createDataFrame([], "shard int, filter binary")
        whole = fresh.filter("filter is not null").unionByName(_updated_filters(empty, again, self.shards))
        after = replace(after, filters=(*self.filters, self._write(whole.withColumn("version", F.lit(after.version)), "filters")))
        return after._committed(spark)

    def compact(self, spark: SparkSession) -> LineIndex:
        """The same index with one segment of each table."""
        after = replace(self, version=self.version + 1)
        references = self._write(self.held(spark).withColumn("sign", F.lit(1)), "references")
        counts = self._write(self.counted(spark).withColumn("version", F.lit(after.version)), "counts")
        filters = self._write(self.screened(spark).withColumn("version", F.lit(after.version)), "filters")
        return replace(after, references=(references,), counts=(counts,), filters=(filters,))._committed(spark)

    # ---- manifests

    def _committed(self, spark: SparkSession) -> LineIndex:
        row = spark.createDataFrame([(self.version, json.dumps(asdict(self)))], "version int, manifest string").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/manifests/version={self.version:09d}")
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        """The newest committed version under ``path``."""
        rows = spark.read.schema("manifest string, version int").parquet(f"{path}/manifests")
        state = json.loads(rows.orderBy(F.desc("version")).first()["manifest"])
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in state.items()})

    # ---- use

    def apply(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), small_bytes: int = SMALL_BYTES) -> DataFrame:
        """The ``keep`` columns, n_lines, n_dropped (long) and ``kept`` (text) of every row of ``docs`` (doc_id, text).

        A line goes if its key is held by ``least_docs`` documents or more and doc_id is not the largest of
        them.  Other lines stay as they are, joined by a line feed; a text of which all goes is
        empty.  Rows without doc_id keep all.  The exact keys are sent to the tasks if they
        are ``small_bytes`` at most; beyond that the lines that pass the filters are joined with them.
        """
        spark = docs.sparkSession
        held = self.counted(spark).filter(f"docs >= {self.least_docs}").select("key", "docs", "last")
        rows = docs.select(*keep, F.col("doc_id").cast("long").alias("__doc"), F.col("text").cast("string").alias("__text"))
        if held.count() * 24 <= small_bytes:
            table = held.select("key", "last").toArrow()
            keys = _fixed(table["key"])
            order = np.argsort(keys)
            exact = spark.sparkContext.broadcast((keys[order], table["last"].to_numpy()[order]))
            screen = spark.sparkContext.broadcast(self._screen(spark, None))
            return rows.mapInArrow(_kept_lines(docs.select(*keep).schema, self.shards, self.least_chars, screen, exact), _kept_schema(docs, keep))
        return self._joined(spark, rows, docs, keep, held, small_bytes)

    def _screen(self, spark: SparkSession, most: int | None) -> dict[int, bytes] | None:
        filters = self.screened(spark)
        if most is not None and (filters.agg(F.sum(F.length("filter"))).first()[0] or 0) > most:
            return None
        return {r.shard: bytes(r.filter) for r in filters.collect()}

    def _joined(self, spark: SparkSession, rows: DataFrame, docs: DataFrame, keep: tuple[str, ...], held: DataFrame, small_bytes: int) -> DataFrame:
        """:meth:`apply` with the exact keys joined to the references of the rows."""
        screen, least_chars, shards = self._screen(spark, small_bytes), self.least_chars, self.shards
        screen = screen if screen is None else spark.sparkContext.broadcast(screen)

        def suspects(batches):
            for batch in batches:
                for part in chunks(batch, "__text"):
                    lines = Lines(part.column("__text"), least_chars)
                    at = np.flatnonzero(_passes(lines, shards, screen))
                    yield pa.RecordBatch.from_arrays([lines.keys.take(pa.array(at)).cast(pa.binary()), part.column("__doc").take(pa.array(lines.row[at]))],
                                                     names=["key", "__of"])

        lines = (rows.select("__doc", "__text").filter("__doc is not null").mapInArrow(suspects, "key binary, __of long").distinct())
        # at most HOT_SHARE keys hold as many references as that; the rest of a key's rows fit a task
        all_held = held.agg(F.sum("docs")).first()[0] or 0
        hot = held.filter(F.col("docs") * HOT_SHARE >= all_held)
        cold = held.filter(F.col("docs") * HOT_SHARE < all_held)
        gone = (lines.join(F.broadcast(hot.select("key", "last")), "key").unionByName(lines.join(cold.select("key", "last"), "key"))
                .filter("__of != last").groupBy("__of").agg(F.collect_list("key").alias("__gone")))
        # rows without doc_id lose nothing; they need no partner
        found = (rows.filter("__doc is not null").join(gone, F.col("__doc") == F.col("__of"), "left").drop("__of")
                 .unionByName(rows.filter("__doc is null").withColumn("__gone", F.lit(None).cast("array<binary>"))))
        return found.mapInArrow(_kept_lines(docs.select(*keep).schema, shards, least_chars, screen, None), _kept_schema(docs, keep))


def _kept_schema(docs: DataFrame, keep: tuple[str, ...]):
    return with_fields(docs.select(*keep).schema, "n_lines long, n_dropped long, kept string")


def _passes(lines: Lines, shards: int, screen) -> np.ndarray:
    """Whether the filter of its shard may know each long line (all of them without filters)."""
    if screen is None or not len(lines.keys):
        return np.ones(len(lines.keys), dtype=bool)
    raw = np.frombuffer(b"".join(lines.keys.to_pylist()), dtype=np.uint8).reshape(-1, 16)
    shard = raw[:, 12:].copy().view(">u4").ravel().astype(np.int64) % shards
    hashes, out = raw[:, :8].copy().view("<u8").ravel(), np.zeros(len(raw), dtype=bool)
    for s in np.unique(shard).tolist():
        if s in screen.value:
            of = np.flatnonzero(shard == s)
            out[of] = _opened(screen.value[s]).holds(hashes[of])
    return out


_OPENED: dict[int, tuple[bytes, CuckooFilter]] = {}


def _opened(data: bytes) -> CuckooFilter:
    got = _OPENED.get(id(data))
    if got is None or got[0] is not data:
        if len(_OPENED) > 4096:
            _OPENED.clear()
        got = _OPENED[id(data)] = (data, CuckooFilter(np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS)))
    return got[1]


def _kept_lines(kept_schema, shards: int, least_chars: int, screen, exact):
    names = [*kept_schema.names, "n_lines", "n_dropped", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                lines = Lines(part.column("__text"), least_chars)
                drop = np.zeros(len(lines.raw), dtype=bool)
                at = np.flatnonzero(_passes(lines, shards, screen))
                keys, row = lines.keys.take(pa.array(at)), lines.row[at]
                if exact is None:
                    gone = [set(g or ()) for g in part.column("__gone").to_pylist()]
                    out = np.array([k in gone[r] for k, r in zip(keys.to_pylist(), row.tolist())], dtype=bool)
                elif len(exact.value[0]):
                    known, last = exact.value
                    keys, ids = _fixed(keys), part.column("__doc").take(pa.array(row))
                    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    out = (known[place] == keys) & ids.is_valid().to_numpy(zero_copy_only=False) & (last[place] != pc.fill_null(ids, 0).to_numpy())
                else:
                    out = np.zeros(len(at), dtype=bool)
                drop[lines.long[at[out]]] = True
                offsets = np.concatenate([[0], np.cumsum(~drop)])[lines.offsets]
                texts = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), lines.raw.filter(pa.array(~drop)))
                total = np.diff(lines.offsets)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(kept_schema))), pa.array(total, pa.int64()), pa.array(total - np.diff(offsets), pa.int64()),
                     pc.binary_join(texts, pa.scalar("\n", pa.large_string())).cast(pa.string())], names=names)

    return run
