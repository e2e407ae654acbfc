import pytest
from pyspark.sql import Observation

from brisa.operators.clean import zero_to_null
from brisa.operators.codec import decode, encode
from brisa.schema import READING_SCHEMA


def _frames(spark, hexes):
    rows = [(i, None if h is None else bytearray(bytes.fromhex(h))) for i, h in enumerate(hexes)]
    return spark.createDataFrame(rows, "i int, value binary")


def test_known_payloads_decode(spark):
    df = _frames(spark, ["", "0804", "0803120178290000000000000000"])
    out = {r.i: r for r in decode(df, keep=["i"], engine="arrow").collect()}
    assert out[0].objectid == 0 and out[0].data == "" and out[0].codnum is None and out[0].chuva is None
    assert out[1].objectid == 4 and out[1].temp is None
    assert out[2].objectid == 3 and out[2].data == "x" and out[2].chuva == 0.0
    cleaned = zero_to_null(decode(df, keep=["i"], engine="arrow")).filter("i = 2").first()
    assert cleaned.chuva is None


@pytest.mark.parametrize("bad", ["ffff", None])
def test_corrupt_and_tombstone(spark, bad):
    df = _frames(spark, ["0804", bad])
    with pytest.raises(Exception):
        decode(df, mode="failfast", engine="arrow").collect()
    obs = Observation("dec")
    kept = decode(df, mode="permissive", engine="arrow", observation=obs).collect()
    assert [r.objectid for r in kept] == [4]
    assert obs.get["dropped"] == 1 and obs.get["received"] == 2


def test_roundtrip_keeps_presence(spark):
    row = {f.name: None for f in READING_SCHEMA.fields}
    row.update(objectid=7, data="d", codnum=-3, estacao="é", chuva=0.0, lat=-12.5, y_utm_sirgas2000=1e-5)
    df = spark.createDataFrame([row], READING_SCHEMA)
    back = decode(encode(df, engine="arrow"), engine="arrow").first().asDict()
    assert back == row


def test_encoded_bytes_match_wire_format(spark):
    row = {f.name: None for f in READING_SCHEMA.fields}
    row.update(objectid=3, data="x", chuva=0.0)
    df = spark.createDataFrame([row], READING_SCHEMA)
    assert bytes(encode(df, engine="arrow").first().value).hex() == "0803120178290000000000000000"


def test_payload_size_formula_on_edge_values(spark):
    import duckdb
    import pyarrow as pa

    from brisa.operators.codec import payload_size_sql

    base = {f.name: None for f in READING_SCHEMA.fields}
    cases = [
        dict(objectid=0, data=""),                                   # empty payload
        dict(objectid=127, data="x", codnum=-1),                      # negative int32: 10-byte varint
        dict(objectid=128, data="é" * 70, estacao="ação"),            # multi-byte UTF-8, 2-byte length
        dict(objectid=2**62, data="d", pm2_5=1.0, y_utm_sirgas2000=0.0),  # big varint, tags >= 16
        dict(objectid=-5, data="d", codnum=2**31 - 1, lat=float("nan")),
    ]
    rows = [{**base, **c} for c in cases]
    df = spark.createDataFrame(rows, READING_SCHEMA)
    got = {r.objectid: r.n for r in encode(df, keep=["objectid"], engine="arrow")
           .selectExpr("objectid", "octet_length(value) AS n").collect()}
    types = {"objectid": pa.int64(), "codnum": pa.int32(), "data": pa.string(), "estacao": pa.string()}
    tbl = pa.table({f.name: pa.array([r[f.name] for r in rows], types.get(f.name, pa.float64()))
                    for f in READING_SCHEMA.fields})  # Arrow keeps NaN distinct from null
    want = dict(duckdb.sql(f"SELECT objectid, {payload_size_sql()} FROM tbl").fetchall())
    assert got == want


def _random_columns(n, seed=5):
    import random

    import pyarrow as pa

    from brisa.operators import codec

    rng, out = random.Random(seed), []
    choices = {pa.int64(): [0, 1, 128, -1, 2**63 - 1, -2**63], pa.int32(): [0, 5, -1, 2**31 - 1, -2**31], pa.string(): ["", "x", "é" * 70, "a" * 200],
               pa.float64(): [0.0, -0.0, float("inf"), float("nan"), -1.5, 1e-5]}
    for _, t, _ in codec.READING_FIELDS:
        kind = codec._ARROW_TYPES[type(t)]
        out.append(pa.array([None if rng.random() < 0.3 else rng.choice(choices[kind]) for _ in range(n)], type=kind))
    return out


def test_whole_batches_need_no_runtime(monkeypatch):
    """Batches are handled field by field; the runtime gives the same payloads and values."""
    from brisa.operators import codec

    columns = [c.slice(3) for c in _random_columns(200)]
    payloads = codec._encode_rows(*columns)
    values = [str(c.to_pylist()) for c in codec._decode_rows(payloads.to_pylist(), True)]

    def refuse(*args):
        raise AssertionError("row by row")

    monkeypatch.setattr(codec, "_encode_rows", refuse)
    monkeypatch.setattr(codec, "_decode_rows", refuse)
    got = codec._encode_batch(*columns)
    assert got.to_pylist() == payloads.to_pylist()
    assert [str(c.to_pylist()) for c in codec._decode_batch(got, True).flatten()] == values


def test_odd_payloads_decode_as_by_the_runtime():
    """Fields twice, out of order, unknown, cut, not UTF-8, with padded or too long varints."""
    import random

    import pyarrow as pa

    from brisa.operators import codec

    rng = random.Random(7)
    whole = codec._encode_rows(*_random_columns(100)).to_pylist()
    odd = [None, b"", *map(bytes.fromhex, ("ffff", "08040805", "1800", "1803 0804", "f80105 0804", "1202fffe", "1202c3a9", "128000", "088000",
                                           "08" + "ff" * 9 + "01", "08" + "ff" * 9 + "02", "18ffffffffff01", "12" + "ff" * 9 + "01", "08"))]
    for p in filter(None, whole):
        cut = rng.randrange(len(p))
        odd += [p[:cut], p + rng.choice(whole), p[:cut] + bytes([rng.getrandbits(8)]) + p[cut + 1:], p]
    got = codec._decode_batch(pa.array(odd, type=pa.binary()), False).flatten()
    for a, b in zip(got, codec._decode_rows(odd, False)):
        assert str(a.to_pylist()) == str(b.to_pylist())
