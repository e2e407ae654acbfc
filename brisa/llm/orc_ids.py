"""Token ids in ORC: integer run-length encoded stripes, row indexes, Bloom filters on doc_id.

``write_ids`` range-partitions the documents by doc_id, encodes each partition in
order and writes one ORC file per partition.  A row holds the document's ids and
its offset inside the file; the files' totals (one row per file) give the offset
over the whole corpus.  Readers split files by stripe and skip stripes and row
groups by the statistics and Bloom filters of doc_id.

The tokenizer is the ``tokenizers`` library.  Its pre-tokenizer never joins text
across a change of character class, so texts are cut there and each distinct piece
is encoded by the library once per worker and looked up from then on.  The table is
bounded; what finds no room is encoded again.  Texts that hold an added token go to
the library whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import list_array, tasks_for

END_ID = 0
#: white space of the pre-tokenizer's expression (fixed values: Unicode White_Space)
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: characters whose class is certain: Latin letters, ASCII digits, ASCII punctuation
LETTER, DIGIT, SIGN = "A-Za-zÀ-ÖØ-öø-ʯ", "0-9", r"!-/:-@\[-`{-~"
SHORT = "'(?:s|t|re|ve|m|ll|d)"
PLAIN = f" ?(?:[{LETTER}]++|[{DIGIT}]++|[{SIGN}]++)"
#: one piece of the pre-tokenizer, or (characters of other classes) several up to the next white space
PIECE = re.compile(f"{SHORT}|{PLAIN}(?![^{SPACE}{LETTER}{DIGIT}{SIGN}])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
ONE = re.compile(f"{SHORT}|{PLAIN}|[{SPACE}]+")
#: pieces whose ids a worker keeps, and their length at most
ROOM, LONGEST = 300_000, 256


class _Table(dict):
    """Ids by text; unknown texts are computed, and kept while there is room."""

    def __init__(self, compute, room: int):
        super().__init__()
        self.compute, self.room = compute, room

    def __missing__(self, text: str) -> bytes:
        ids = self.compute(text)
        if len(self) < self.room and len(text) <= LONGEST:
            self[text] = ids
        return ids


class Encoder:
    """``encode(text)``: the library's ids as little-endian uint32 bytes."""

    def __init__(self, path: str, room: int = ROOM):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        # the byte-level alphabet, as the library gives it
        from tokenizers.pre_tokenizers import ByteLevel
        self.letters = {}
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        for c in range(0x80):
            self.letters[c] = level.pre_tokenize_str(chr(c))[0][0]
        for c in range(0x80, 0x100):  # bytes of UTF-8 sequences: lead and trailing bytes seen in some character
            self.letters[c] = None
        for c in (*range(0x80, 0x800), *range(0x800, 0x10000, 0x40), *range(0x10000, 0x110000, 0x1000)):
            if 0xD800 <= c < 0xE000:
                continue
            for b, x in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0]):
                self.letters[b] = x
        self.letters = {b: x for b, x in self.letters.items() if x is not None}
        self.blank = self.letters[0x20]
        self.pieces = _Table(self._piece, room)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, text: str) -> bytes:
        if not ONE.fullmatch(text):
            return self._whole(text)
        if text.isascii() and text.isprintable():  # of these only the space has another letter
            text = text.replace(" ", self.blank)
        else:
            text = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID, texts_at_once: int = 256) -> DataFrame:
    """doc_id, file_start, n_tokens, ids of each row, in the order of the rows; file_start counts
    from the start of the partition.  Null texts are empty: just the end id."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(tokenizer), 0
        for batch in batches:
            for a in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(a, texts_at_once)
                rows = [encoder.encode(t or "") + end for t in part.column("text").to_pylist()]
                counts = np.array([len(x) // 4 for x in rows], dtype=np.int64)
                total = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(before + total - counts), pa.array(counts),
                    list_array(np.frombuffer(b"".join(rows), dtype="<i4"), counts, pa.int32()),
                ], names=["doc_id", "file_start", "n_tokens", "ids"])
                before += int(total[-1])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, file_start long, n_tokens long, ids array<int>"))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, files: int | None = None,
              stripe_bytes: int = 64 << 20, index_rows: int = 1000) -> None:
    """Write the ids of ``docs`` (doc_id, text) as ORC files in ascending doc_id order.

    Rows of one doc_id are ordered by text; null doc_ids come first; an empty table
    gives a file without rows.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange(files or tasks_for(docs), "doc_id", F.xxhash64("text")).sortWithinPartitions(*order)
    (encoded(rows, tokenizer, end_id).withColumn("file", F.spark_partition_id())
     .write.mode("overwrite").option("compression", "zstd").option("orc.stripe.size", str(stripe_bytes))
     .option("orc.row.index.stride", str(index_rows)).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


SCHEMA = "doc_id long, file_start long, n_tokens long, ids array<int>, file int"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids.  Filters on doc_id reach the scan."""
    rows = spark.read.schema(SCHEMA).orc(path)
    # one row per file: its ids, and those of the files before it; as many rows as files
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = files.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    return rows.join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def checksums(ids: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    def run(batches):
        for batch in batches:
            col = batch.column("ids")
            offs = col.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
            crc = array("q", (zlib.crc32(flat[4 * a:4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, type=pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return ids.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
