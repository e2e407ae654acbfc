"""Embedding whitening over a bit-sliced scatter matrix.

Entries become integers x = floor(scale * c).  For a block of distinct vectors every
dimension is shifted to start at 0, its bit planes are packed across the rows into 64-bit
words, and the cross-product of two dimensions is the sum of 2^(a + b) times the number of
ones in plane a of one AND plane b of the other: exact, whatever the size of the entries.
The sums of all blocks are centred as integers before the eigenvectors are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import stage, with_fields

SCALE, COMPONENTS = 256, 4
#: rows packed into bit planes at once
BLOCK_ROWS = 8192
#: below this share of the largest eigenvalue a component counts as without variance (doubles do not resolve it)
FLAT = 1e-11
#: big sums travel in three limbs of this many bits, the last one signed
LIMB = 60


def _integers(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * c), held to the range of a long."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * values.astype(np.float64))
    top = x >= 2.0 ** 63
    out = np.where(top, 0.0, np.maximum(x, -(2.0 ** 63))).astype(np.int64)
    out[top] = np.iinfo(np.int64).max
    return out


def _pack(x: np.ndarray) -> list[bytes]:
    """Each row in the smallest of 2, 4 or 8 bytes an entry that holds it (one form for one vector)."""
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(x)
    for kind, before in (("<i2", None), ("<i4", "<i2"), ("<i8", "<i4")):
        fits = (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        if before:
            fits &= (low < np.iinfo(before).min) | (high > np.iinfo(before).max)
        at = np.flatnonzero(fits)
        for i, row in zip(at.tolist(), x[at].astype(kind)):
            out[i] = kind[2].encode() + row.tobytes()
    return out


def _unpack(packed: list[bytes], dims: int) -> np.ndarray:
    """The packed rows as an array of longs."""
    out = np.empty((len(packed), dims), dtype=np.int64)
    kinds = np.array([p[0] for p in packed], dtype=np.uint8)
    for kind in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == kind)
        out[at] = np.frombuffer(b"".join([packed[i][1:] for i in at.tolist()]), dtype=f"<i{chr(kind)}").reshape(len(at), dims)
    return out


def quantised(rows: DataFrame, vector: str, keep: tuple[str, ...], scale: float = SCALE) -> DataFrame:
    """The ``keep`` columns, dims and packed x of the rows whose vector is set and finite throughout."""
    schema = with_fields(rows.select(*keep).schema, "dims int, x binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("__vector").cast(pa.large_list(pa.float64()))
            dims = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(vectors)
            entries = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(dims)])
            broken = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
            whole = vectors.is_valid().to_numpy(zero_copy_only=False) & (broken[ends[1:]] == broken[ends[:-1]])
            for d in np.unique(dims[whole]).tolist():
                at = np.flatnonzero(whole & (dims == d))
                x = _integers(entries[ends[at][:, None] + np.arange(d)], scale)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(np.full(len(at), d), pa.int32()),
                                                  pa.array(_pack(x), pa.binary())], names=schema.names)

    return rows.select(*keep, F.col(vector).cast("array<double>").alias("__vector")).mapInArrow(run, schema)


def bit_planes(x: np.ndarray) -> np.ndarray:
    """(dims, bits, words): the bits of each non-negative column, packed across the rows into 64-bit words."""
    rows, dims = x.shape
    bits = max(1, int(x.max(initial=0)).bit_length())
    padded = np.zeros((dims, -(-rows // 64) * 64), dtype=np.uint64)
    padded[:, :rows] = x.T
    out = np.empty((dims, bits, padded.shape[1] // 64), dtype=np.uint64)
    for b in range(bits):
        ones = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[:, b] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)
    return out


def scatter(x: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Exact column sums and cross-products (i <= j, Python integers) of an integer block."""
    rows, dims = x.shape
    low = [int(v) for v in x.min(axis=0)]
    shifted = x.astype(np.uint64) - x.min(axis=0).astype(np.uint64)  # wraps to the true difference
    planes = bit_planes(shifted)
    bits = planes.shape[1]
    ones = np.bitwise_count(planes).sum(axis=2, dtype=np.int64)
    sums = [sum(int(ones[i, a]) << a for a in range(bits)) for i in range(dims)]
    out = np.zeros((dims, dims), dtype=object)
    for i in range(dims):
        weights = np.zeros((dims - i, 2 * bits - 1), dtype=np.int64)  # ones by a + b
        for a in range(bits):
            both = np.bitwise_count(planes[i:] & planes[i, a]).sum(axis=2, dtype=np.int64)
            weights[:, a:a + bits] += both
        if 2 * bits - 1 + rows.bit_length() < 62:
            cross = (weights << np.arange(2 * bits - 1)).sum(axis=1).tolist()
        else:
            cross = [sum(int(w) << s for s, w in enumerate(row)) for row in weights.tolist()]
        for j, c in zip(range(i, dims), cross):  # undo the shifts
            out[i, j] = c + low[j] * sums[i] + low[i] * sums[j] + rows * low[i] * low[j]
    return [s + rows * m for s, m in zip(sums, low)], out


def _moments(fit: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and the cross-products (a full symmetric matrix) of the fit list; dims^2 numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, [0] * dims, np.zeros((dims, dims), dtype=object)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                x = _unpack(batch.column("x").slice(a, BLOCK_ROWS).to_pylist(), dims)
                s, c = scatter(x)
                n, sums, cross = n + len(x), [p + q for p, q in zip(sums, s)], cross + c
        if n:
            cells = [(-1, -1, n), *((i, -1, s) for i, s in enumerate(sums)),
                     *((i, j, cross[i, j]) for i in range(dims) for j in range(i, dims))]
            mask = (1 << LIMB) - 1
            limbs = [[v & mask for _, _, v in cells], [(v >> LIMB) & mask for _, _, v in cells], [v >> (2 * LIMB) for _, _, v in cells]]
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], pa.int32()) for k in (0, 1)] + [pa.array(v, pa.int64()) for v in limbs],
                                             names=["i", "j", "l0", "l1", "l2"])

    cells = (fit.select("x").mapInArrow(run, "i int, j int, l0 long, l1 long, l2 long").groupBy("i", "j")
             .agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("l0", "l1", "l2"))).collect())
    value = {(r.i, r.j): int(r.l0) + (int(r.l1) << LIMB) + (int(r.l2) << (2 * LIMB)) for r in cells}
    cross = np.array([[value[min(i, j), max(i, j)] for j in range(dims)] for i in range(dims)], dtype=object)
    return value[-1, -1], [value[i, -1] for i in range(dims)], cross


def covariance(n: int, sums: list[int], cross: np.ndarray) -> np.ndarray:
    """The covariance with divisor n, centred as integers, each entry rounded once."""
    dims = len(sums)
    return np.array([[(n * cross[i, j] - sums[i] * sums[j]) / (n * n) for j in range(dims)] for i in range(dims)], dtype=np.float64).reshape(dims, dims)


def whiten(rows: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS,
           scale: float = SCALE) -> DataFrame:
    """Whitened rows: the ``keep`` columns, component (from 1, by falling eigenvalue), n, deviation, whitened,
    explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry go.  The fit list holds each distinct
    integer vector once: n vectors.  deviation is sum((n * x - S)^2), a decimal(38,0) (null if it
    has more digits).  The largest absolute entry of each eigenvector is positive.  Vectors of another
    length than the most frequent one (ties: the longest) go as well.  A component without variance
    has explained 0 and whitened null; identity_error is over the others (null if there is none).
    Fewer dimensions give fewer components; no rows give none.  Rows may repeat, ids may be null.
    Names in ``keep`` may be any but the new ones.
    """
    schema = with_fields(rows.select(*keep).schema,
                         "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    spark = rows.sparkSession
    # names of one's own: a kept column may be called x or dims
    own = tuple(f"k{i}" for i in range(len(keep)))
    renamed = rows.select(F.col(vector).alias("__v"), *(F.col(k).alias(o) for k, o in zip(keep, own)))
    whole = stage(quantised(renamed, "__v", own, scale), "whitening-rows")
    common = whole.filter("dims > 0").groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common["dims"]
    whole = whole.filter(F.col("dims") == dims)
    fit = stage(whole.select("x").distinct(), "whitening-fit")
    n, sums, cross = _moments(fit, dims)
    v = covariance(n, sums, cross)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = float(sum(Fraction(n * cross[i, i] - sums[i] ** 2, n * n) for i in range(dims)))
    real = values > FLAT * max(values[0], 0.0) if values[0] > 0 else np.zeros(len(values), dtype=bool)
    centre = np.array([float(Fraction(s, n)) for s in sums])
    turn = vectors / np.sqrt(np.where(real, values, 1.0))
    wanted = np.flatnonzero(real).tolist()

    def projected(x: np.ndarray) -> np.ndarray:
        return (x - centre) @ turn

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = projected(_unpack(batch.column("x").to_pylist(), dims))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in wanted], names=[f"w{k}" for k in wanted])

    error = None
    if wanted:
        w = stage(fit.mapInArrow(fitted, ", ".join(f"w{k} double" for k in wanted)), "whitening-fitted")
        mean = w.agg(*(F.avg(f"w{k}").alias(f"w{k}") for k in wanted)).first()
        pairs = [(a, b) for a in wanted for b in wanted if a <= b]
        products = w.agg(*(F.sum((F.col(f"w{a}") - mean[f"w{a}"]) * (F.col(f"w{b}") - mean[f"w{b}"])).alias(f"p{a}_{b}") for a, b in pairs)).first()
        error = max(abs(products[f"p{a}_{b}"] / n - (a == b)) for a, b in pairs)
    explained = [float(e) / trace if ok else 0.0 for e, ok in zip(values.tolist(), real.tolist())]
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpack(batch.column("x").to_pylist(), dims)
            w = np.where(real, projected(x), np.nan).ravel()
            far = max(abs(n * int(x.min()) - m) + abs(n * int(x.max()) - m) for m in (min(sums), max(sums)))
            if far * far * dims < 1 << 63:
                wrapped = np.array([m % (1 << 64) for m in sums], dtype=np.uint64).view(np.int64)  # the difference fits
                deviation = ((n * x - wrapped) ** 2).sum(axis=1).tolist()
            else:
                deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
            deviation = [d if d < 10 ** 38 else None for d in deviation]
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(each) for i in range(len(own))), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                 pa.array(np.full(len(each), n), pa.int64()), pa.array(deviation, pa.decimal128(38, 0)).take(each),
                 pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, len(x))), pa.array([error] * len(each), pa.float64())], names=schema.names)

    return whole.select(*own, "x").mapInArrow(run, schema)
