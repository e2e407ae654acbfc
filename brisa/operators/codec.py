"""Reading record <-> binary payload (protobuf wire format).

Preferred path: Spark's built-in ``to_protobuf`` / ``from_protobuf`` when the
spark-protobuf package is on the classpath (pure JVM, codegen'd around it).
Fallback path: an Arrow UDF that handles a whole batch field by field; payloads
that are laid out in another way (and wrong ones) go to the public ``google.protobuf``
runtime row by row.  Payloads of both paths are interchangeable.

Modes: ``"failfast"`` - an undecodable or null payload fails the task (and so the
query), as the source job does; ``"permissive"`` - such rows are dropped, and
counted through ``DataFrame.observe`` when an observation name is given.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.operators.parallelism import ensure_parallelism
from brisa.schema import READING_FIELDS

PACKAGE = "brisa"
MESSAGE = "Reading"
FULL_NAME = f"{PACKAGE}.{MESSAGE}"

_ARROW_TYPES = {
    T.LongType: pa.int64(),
    T.IntegerType: pa.int32(),
    T.DoubleType: pa.float64(),
    T.StringType: pa.string(),
}


@functools.lru_cache(maxsize=1)
def descriptor_set_bytes() -> bytes:
    """Serialized FileDescriptorSet of the reading message (proto3, optional fields)."""
    from google.protobuf import descriptor_pb2 as d

    fdp = d.FileDescriptorProto(name="brisa_reading.proto", package=PACKAGE, syntax="proto3")
    msg = fdp.message_type.add(name=MESSAGE)
    wire = {T.LongType: d.FieldDescriptorProto.TYPE_INT64,
            T.IntegerType: d.FieldDescriptorProto.TYPE_INT32,
            T.DoubleType: d.FieldDescriptorProto.TYPE_DOUBLE,
            T.StringType: d.FieldDescriptorProto.TYPE_STRING}
    for tag, (name, dtype, optional) in enumerate(READING_FIELDS, start=1):
        f = msg.field.add(name=name, number=tag, type=wire[type(dtype)],
                          label=d.FieldDescriptorProto.LABEL_OPTIONAL)
        if optional:  # proto3 `optional`: a synthetic one-field oneof gives presence
            f.proto3_optional = True
            f.oneof_index = len(msg.oneof_decl)
            msg.oneof_decl.add(name=f"_{name}")
    return d.FileDescriptorSet(file=[fdp]).SerializeToString()


@functools.lru_cache(maxsize=1)
def message_class():
    """Generated-at-runtime message class; built once per Python worker."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for fdp in descriptor_pb2.FileDescriptorSet.FromString(descriptor_set_bytes()).file:
        pool.Add(fdp)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(FULL_NAME))


def builtin_available(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.protobuf.CatalystDataToProtobuf")
        return True
    except Exception:  # no JVM gateway (Connect) or package not on the classpath
        return False


# ---------------------------------------------------------------- arrow fallback

_NAMES = [n for n, _, _ in READING_FIELDS]
_OPTIONAL = [opt for _, _, opt in READING_FIELDS]
_DECODED_TYPE = T.StructType(
    [T.StructField(n, t, True) for n, t, _ in READING_FIELDS]
    + [T.StructField("_ok", T.BooleanType(), False)]
)


def _py_values(a: pa.Array) -> list:
    """Python values of an Arrow array, None where null (fast path via numpy)."""
    if a.null_count == 0 and pa.types.is_floating(a.type):
        return a.to_numpy(zero_copy_only=False).tolist()
    return a.to_pylist()


def _encode_rows(*arrays: pa.Array) -> pa.Array:
    """Payloads by the protobuf runtime, one row at a time."""
    msg = message_class()()  # one message object per batch, cleared per row
    n = len(arrays[0]) if arrays else 0
    # Columns that are null in the whole batch contribute nothing to the payload.
    live = [(name, _py_values(a)) for name, a in zip(_NAMES, arrays) if a.null_count < n]
    clear, serialize = msg.Clear, msg.SerializeToString
    out = [b""] * n
    for i in range(n):
        clear()
        for name, values in live:
            v = values[i]
            if v is not None:
                setattr(msg, name, v)
        out[i] = serialize()
    return pa.array(out, type=pa.binary())


def _decode_rows(payloads: list, failfast: bool) -> list[pa.Array]:
    """The 26 columns and ``_ok`` by the protobuf runtime, one row at a time."""
    from google.protobuf.message import DecodeError

    msg = message_class()()  # one message object per batch, cleared per row
    clear, merge, list_fields = msg.Clear, msg.MergeFromString, msg.ListFields
    n = len(payloads)
    cols: list[list] = [[None] * n for _ in _NAMES]
    cols[0] = [0] * n    # objectid: no presence, absent reads as 0
    cols[1] = [""] * n   # data: no presence, absent reads as ""
    ok = [True] * n
    for i, payload in enumerate(payloads):
        try:
            if payload is None:
                raise DecodeError("null payload (tombstone)")
            clear()
            merge(payload)
            fields = list_fields()
        except DecodeError:
            if failfast:
                raise
            ok[i] = False
            cols[0][i] = None
            cols[1][i] = None
            continue
        for fd, v in fields:
            cols[fd.index][i] = v
    arrays = [pa.array(c, type=_ARROW_TYPES[type(t)]) for c, (_, t, _) in zip(cols, READING_FIELDS)]
    arrays.append(pa.array(ok, type=pa.bool_()))
    return arrays


# A whole batch is encoded or decoded field by field, every row's place in its payload being one
# entry of ``pos``.  What is not laid out as the encoder does it goes to the runtime, row by row.

_PAD = 16  # bytes behind the payloads, so that reads at a place inside need no check


def _key(tag: int, dtype: T.DataType) -> bytes:
    wire = 1 if isinstance(dtype, T.DoubleType) else 2 if isinstance(dtype, T.StringType) else 0
    key = tag << 3 | wire
    return bytes([key]) if key < 128 else bytes([key & 127 | 128, key >> 7])


_KEYS = [_key(tag, t) for tag, (_, t, _) in enumerate(READING_FIELDS, start=1)]


def _at_any_byte(buf: np.ndarray, dtype: str) -> np.ndarray:
    """``buf`` as items of ``dtype`` that begin at every byte."""
    return np.ndarray((len(buf) - np.dtype(dtype).itemsize + 1,), dtype, buf, strides=(1,))


def _bits(present: np.ndarray) -> pa.Buffer | None:
    return None if present.all() else pa.py_buffer(np.packbits(present, bitorder="little"))


def _varint_sizes(values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        more = values >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        out += more
    return out


def _put_varints(out: np.ndarray, at: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
    for k in range(int(sizes.max(initial=0))):
        rows = sizes > k
        out[at[rows] + k] = ((values[rows] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | (128 * (sizes[rows] > k + 1)).astype(np.uint8)


def _varints(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and size of the varint at each place; size 0 if it does not end."""
    values, sizes = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    rows = np.arange(len(at))
    for k in range(10):
        b = buf[np.minimum(at[rows] + k, len(buf) - 1)]
        if k == 9:
            rows, b = rows[b <= 1], b[b <= 1]  # more than 64 bits
        values[rows] |= (b & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
        ends = b < 128
        sizes[rows[ends]] = k + 1
        rows = rows[~ends]
        if not len(rows):
            break
    return values, sizes


def _gathered(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all the slices one after the other, and their n + 1 offsets."""
    offs = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offs[1:])
    return buf[np.arange(offs[-1]) + np.repeat(starts - offs[:-1], lengths)], offs


def _flat(a: pa.Array, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text or binary column and its n + 1 offsets into them (what null rows hold is not told)."""
    a = a.cast(kind)
    _, offsets, data = a.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[a.offset:a.offset + len(a) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offs


def _encode_batch(*arrays: pa.Array) -> pa.Array:
    n = len(arrays[0]) if arrays else 0
    sizes, parts = np.zeros(n, dtype=np.int64), []
    for a, key, (_, dtype, optional) in zip(arrays, _KEYS, READING_FIELDS):
        if a.null_count == n:
            continue
        present = np.ones(n, dtype=bool) if a.null_count == 0 else a.is_valid().to_numpy(zero_copy_only=False)
        if isinstance(dtype, T.StringType):
            try:
                a.validate(full=True)
            except pa.ArrowInvalid:  # no UTF-8
                return _encode_rows(*arrays)
            data, offs = _flat(a, pa.large_string())
            value = offs[1:] - offs[:-1]
        else:
            value = pc.fill_null(a, 0).to_numpy(zero_copy_only=False)
        if not optional:
            present = present & (value != 0)
        rows = np.flatnonzero(present)
        value = value[rows]
        if isinstance(dtype, T.DoubleType):
            parts.append((key, rows, np.ascontiguousarray(value, dtype="<f8"), None, None))
            sizes[rows] += len(key) + 8
        else:
            value = value.astype(np.int64).view(np.uint64)
            width = _varint_sizes(value)
            text = (data, offs[:-1][rows]) if isinstance(dtype, T.StringType) else None
            parts.append((key, rows, value, width, text))
            sizes[rows] += len(key) + width + (value.astype(np.int64) if text else 0)
    offs = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(sizes, out=offs[1:])
    if offs[-1] > 0x7FFFFFFF:
        return _encode_rows(*arrays)
    out, pos = np.zeros(int(offs[-1]) + _PAD, dtype=np.uint8), offs[:-1].copy()
    for key, rows, value, width, text in parts:
        at = pos[rows]
        if width is None:  # key and double at once
            item = np.empty((len(rows), len(key) + 8), dtype=np.uint8)
            item[:, :len(key)] = np.frombuffer(key, dtype=np.uint8)
            item[:, len(key):] = value.view(np.uint8).reshape(-1, 8)
            kind = f"V{len(key) + 8}"
            _at_any_byte(out, kind)[at] = item.view(kind).ravel()
            pos[rows] = at + len(key) + 8
            continue
        for k, b in enumerate(key):
            out[at + k] = b
        at = at + len(key)
        _put_varints(out, at, value, width)
        at = at + width
        if text:
            data, lengths = text[0], value.astype(np.int64)
            piece, starts = _gathered(data, text[1], lengths)
            out[np.arange(len(piece)) + np.repeat(at - starts[:-1], lengths)] = piece
            at = at + lengths
        pos[rows] = at
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(out)])


def _decode_batch(values: pa.Array, failfast: bool) -> pa.Array:
    n = len(values)
    data, offs = _flat(values, pa.large_binary())
    buf = np.concatenate([data[:offs[-1]], np.zeros(_PAD, dtype=np.uint8)])
    pos, ends = offs[:-1].copy(), offs[1:]
    good = np.ones(n, dtype=bool) if values.null_count == 0 else values.is_valid().to_numpy(zero_copy_only=False)
    one, two, doubles = buf, _at_any_byte(buf, "<u2"), _at_any_byte(buf, "<f8")
    arrays = []
    for key, (_, dtype, optional) in zip(_KEYS, READING_FIELDS):
        code = int.from_bytes(key, "little")
        here = (pos + len(key) <= ends) & ((one if len(key) == 1 else two)[pos] == code)
        rows = np.flatnonzero(here)
        at = pos[rows] + len(key)
        valid = _bits(here) if optional else None
        if isinstance(dtype, T.DoubleType):
            column = np.zeros(n, dtype=np.float64)
            column[rows] = doubles[at]
            pos[rows] = at + 8
            arrays.append(pa.Array.from_buffers(pa.float64(), n, [valid, pa.py_buffer(column)]))
            continue
        found, width = _varints(buf, at)
        good[rows[width == 0]] = False
        at = at + width
        if isinstance(dtype, T.StringType):
            over = found > np.maximum(ends[rows] - at, 0).astype(np.uint64)
            good[rows[over]] = False
            lengths, starts = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            lengths[rows], starts[rows] = np.where(over, 0, found).astype(np.int64), at
            pos[rows] = at + lengths[rows]
            piece, bounds = _gathered(buf, starts, lengths)
            column = pa.Array.from_buffers(pa.string(), n, [valid, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(piece)])
            try:
                column.validate(full=True)
            except pa.ArrowInvalid:  # no UTF-8 in one of those beyond ASCII
                good[np.repeat(np.arange(n), lengths)[piece > 127]] = False
            arrays.append(column)
        else:
            kind = np.int32 if isinstance(dtype, T.IntegerType) else np.int64
            column = np.zeros(n, dtype=kind)
            column[rows] = found.view(np.int64).astype(kind)
            pos[rows] = at
            arrays.append(pa.Array.from_buffers(_ARROW_TYPES[type(dtype)], n, [valid, pa.py_buffer(column)]))
    arrays.append(pa.array(np.ones(n, dtype=bool)))
    rest = np.flatnonzero(~(good & (pos == ends)))
    if len(rest):
        slow = _decode_rows(values.take(pa.array(rest)).to_pylist(), failfast)
        pick = np.arange(n)
        pick[rest] = n + np.arange(len(rest))
        arrays = [pa.concat_arrays([a, b]).take(pa.array(pick)) for a, b in zip(arrays, slow)]
    return pa.StructArray.from_arrays(arrays, names=_NAMES + ["_ok"])


def _decode_permissive_batches(keep: list[str]):
    def run(batches):
        for b in batches:
            dec = _decode_batch(b.column("_value"), False)
            cols = [b.column(k) for k in keep] + dec.flatten()
            yield pa.RecordBatch.from_arrays(cols, names=keep + _NAMES + ["_ok"])
    return run


_encode_udf = F.arrow_udf(_encode_batch, T.BinaryType())
_decode_failfast_udf = F.arrow_udf(lambda v: _decode_batch(v, True), _DECODED_TYPE)


# ---------------------------------------------------------------- public API

def encode_col(engine: str = "arrow") -> Column:
    """Payload column for a DataFrame holding the 26 reading columns."""
    if engine == "builtin":
        from pyspark.sql.protobuf.functions import to_protobuf

        return to_protobuf(F.struct(*_NAMES), FULL_NAME, binaryDescriptorSet=descriptor_set_bytes())
    return _encode_udf(*[F.col(n) for n in _NAMES])


def _engine(df: DataFrame, engine: str) -> str:
    if engine == "auto":
        return "builtin" if builtin_available(df.sparkSession) else "arrow"
    return engine


def encode(df: DataFrame, out: str = "value", keep: list[str] | None = None,
           engine: str = "auto") -> DataFrame:
    """Reading columns -> one binary payload column (plus ``keep`` columns)."""
    engine = _engine(df, engine)
    if engine == "arrow":
        df = ensure_parallelism(df)
    return df.select(*(keep or []), encode_col(engine).alias(out))


def decode(df: DataFrame, value_col: str = "value", mode: str = "failfast",
           keep: list[str] | None = None, engine: str = "auto",
           observation: Observation | str | None = None) -> DataFrame:
    """Payload -> 26 typed reading columns (plus ``keep`` columns).

    ``failfast`` raises on a corrupt or null payload; ``permissive`` drops those
    rows.  Pass an ``Observation`` (batch) or a metric name (stream: reported in
    each query progress as ``observedMetrics``) to count the dropped rows without
    a second job.
    """
    if mode not in ("failfast", "permissive"):
        raise ValueError(f"mode must be 'failfast' or 'permissive', got {mode!r}")
    keep = keep or []
    engine = _engine(df, engine)
    v = F.col(value_col)
    if engine == "builtin":
        from pyspark.sql.protobuf.functions import from_protobuf

        opts = {"mode": "FAILFAST" if mode == "failfast" else "PERMISSIVE",
                "emit.default.values": "true"}
        rec = from_protobuf(v, FULL_NAME, options=opts, binaryDescriptorSet=descriptor_set_bytes())
        if mode == "failfast":
            rec = F.when(v.isNull(), F.raise_error(F.lit("null payload (tombstone)"))).otherwise(rec)
        # project the decoded struct once, then expand it (one decode per row)
        parsed = df.select(*keep, rec.alias("_rec"))
        r = F.col("_rec")
        fields = [r.getField(n) for n in _NAMES]
        fields[0] = F.coalesce(fields[0], F.lit(0).cast("long"))
        fields[1] = F.coalesce(fields[1], F.lit(""))
        staged = parsed.select(*keep, *[f.alias(n) for f, n in zip(fields, _NAMES)],
                               r.isNotNull().alias("_ok"))
    elif mode == "failfast":
        df = ensure_parallelism(df)
        staged = df.select(*keep, _decode_failfast_udf(v).alias("_rec")).select(*keep, "_rec.*")
    else:
        # A scalar UDF here would be inlined into the pushed-down ``_ok`` filter
        # and run twice; nothing is pushed through mapInArrow, so each payload is
        # decoded once and the filter (and observation) stay above it.
        src = ensure_parallelism(df).select(*keep, v.alias("_value"))
        schema = T.StructType([src.schema[k] for k in keep] + list(_DECODED_TYPE.fields))
        staged = src.mapInArrow(_decode_permissive_batches(list(keep)), schema)
    if observation is not None:
        staged = staged.observe(observation, F.count_if(~F.col("_ok")).alias("dropped"),
                                F.count(F.lit(1)).alias("received"))
    if mode == "permissive":
        staged = staged.filter(F.col("_ok"))
    return staged.drop("_ok")


def _varint_len_sql(expr: str) -> str:
    """Bytes of a varint for a non-negative integer expression (by rule 2**(7k))."""
    whens = " ".join(f"WHEN {expr} < {2 ** (7 * k)} THEN {k}" for k in range(1, 10))
    return f"CASE {whens} ELSE 10 END"


def payload_size_sql() -> str:
    """DuckDB expression for the encoded size of a reading (an independent check).

    Tags below 16 take one byte, 16 and above two; doubles are 8 bytes; strings are
    length-prefixed UTF-8; negative int32/int64 varints take 10 bytes.  Fields
    without presence are omitted from the wire when they hold the default.
    """
    parts = []
    for tag, (name, dtype, optional) in enumerate(READING_FIELDS, start=1):
        tag_len = 1 if tag < 16 else 2
        if isinstance(dtype, T.DoubleType):
            body = f"{tag_len + 8}"
        elif isinstance(dtype, T.StringType):
            n = f"strlen({name})"
            body = f"({tag_len} + {n} + {_varint_len_sql(n)})"
        else:
            body = f"({tag_len} + CASE WHEN {name} < 0 THEN 10 ELSE {_varint_len_sql(name)} END)"
        if optional:
            parts.append(f"CASE WHEN {name} IS NULL THEN 0 ELSE {body} END")
        elif isinstance(dtype, T.StringType):
            parts.append(f"CASE WHEN {name} = '' THEN 0 ELSE {body} END")
        else:
            parts.append(f"CASE WHEN {name} = 0 THEN 0 ELSE {body} END")
    return " + ".join(parts)
