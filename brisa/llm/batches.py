"""Helpers shared by the operators: Arrow batches of texts as flat bytes, word hashes.

Everything here works on one Arrow batch inside a task.  Word hashes are
polynomials over a random byte table in two prime fields (62 bits), taken from prefix
sums, so a whole batch is hashed with a few vector operations.  (Modulo a power of two
there are words that collide whatever the base.)
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_path

#: bytes of text handled by one round of vector operations
CHUNK_BYTES = 1 << 18
#: rows of a batch with whole texts
BATCH_ROWS = 1000

#: word hashes are polynomials over these prime fields, with these bases
_FIELDS = ((2147483647, 1103515245), (2147483629, 1566083941))


def _powers(n: int, base: int, p: int) -> np.ndarray:
    out = np.ones(n, dtype=np.int64)
    k = 1
    while k < n:  # doubling: powers k..2k are powers 0..k times base^k
        m = min(k, n - k)
        out[k:k + m] = out[:m] * pow(base, k, p) % p
        k += m
    return out


_POW: dict = {"n": 0, "tables": None}


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, up to n - 1."""
    def made(size):
        return [(_powers(size, base, p), _powers(size, pow(base, -1, p), p)) for p, base in _FIELDS]

    if n > 4 * CHUNK_BYTES:  # a very long text: tables for this call only
        return made(n)
    if _POW["n"] < n:
        size = max(n, CHUNK_BYTES + 1)
        _POW.update(n=size, tables=made(size))
    return _POW["tables"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z -> a-z
_BYTE_CODE = [(mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(p)) % np.uint64(p)).astype(np.int64)[_FOLD]
              for p, _ in _FIELDS]

#: bytes inside a word `[^\\x20\\x09-\\x0D]+`
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: bytes inside a word `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def flat_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    a, total = 0, 0
    for i, s in enumerate(sizes):
        if i > a and total + s > limit:
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += int(s)
    if a < batch.num_rows:
        yield batch.slice(a)


def word_bounds(flat: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, and the n + 1 offsets of each text's words."""
    m = inside[flat]
    before = np.zeros(len(m), dtype=bool)
    before[1:] = m[:-1]
    before[offs[:-1][offs[:-1] < len(m)]] = False
    starts = np.flatnonzero(m & ~before)
    after = np.zeros(len(m), dtype=bool)
    after[:-1] = m[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_sums(flat: np.ndarray) -> list[np.ndarray]:
    """What :func:`word_hashes` needs of a text; to be shared by calls on the same one."""
    out = []
    for (p, _), (up, _), code in zip(_FIELDS, _power_tables(len(flat) + 1), _BYTE_CODE):
        sums = np.zeros(len(flat) + 1, dtype=np.int64)  # of numbers below 2^31: no overflow below 2^32 bytes
        np.cumsum(code[flat] * up[:len(flat)] % p, out=sums[1:])
        out.append(sums)
    return out


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: list[np.ndarray] | None = None) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased."""
    if not len(starts):
        return np.empty(0, np.uint64)
    one, two = (((s[ends] - s[starts]) % p * down[starts] % p).astype(np.uint64)
                for (p, _), (_, down), s in zip(_FIELDS, _power_tables(len(flat) + 1), sums or prefix_sums(flat)))
    return mix64((one << np.uint64(31) | two) + mix64((ends - starts).astype(np.uint64)))


_GRAM = 0xC2B2AE3D27D4EB4F


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(_GRAM)
        out += words[j:j + n]
    return mix64(out)


def gram_hashes_at(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the run of k words that begins at each place (as :func:`gram_hashes` has it)."""
    out = np.full(len(at), k, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(_GRAM)
        out += words[at + j]
    return mix64(out)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of values of each row."""
    offs = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, type=kind))


#: shuffle files go when the write that made them ends (else when the driver happens to collect its garbage)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table in the shared folder and read it back (cuts lineage, survives lost executors)."""
    path = shared_path(df.sparkSession, name)
    with setting(df.sparkSession, _CLEANUP, "true"):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the queries that run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> AbstractContextManager[None]:
    """Batches of at most ``rows`` rows for the Arrow functions of queries that run inside.

    A task holds its batch several times (Spark's buffers, the worker's copy, Python values), and whole
    texts make 10 000 rows tens of MB.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    return setting(spark, name, str(rows if now <= 0 else min(rows, now)))


def with_fields(schema: StructType, ddl: str) -> StructType:
    """``schema`` followed by the fields of a DDL string (whatever its own names are)."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tasks_for(df: DataFrame) -> int:
    """Partitions of a keyed exchange over ``df``: spark.sql.shuffle.partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
