"""Whitening against plain integer arithmetic."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brisa.llm.whitening import bit_planes, scatter, whiten
from made import SF001


def test_scatter_is_exact():
    rng = np.random.default_rng(1)
    for top in (1, 5, 300, 1 << 20, 1 << 62):
        x = rng.integers(-top, top, size=(rng.integers(1, 200), 5), endpoint=True)
        sums, cross = scatter(x)
        big = x.astype(object)
        assert sums == big.sum(axis=0).tolist()
        assert all(cross[i, j] == int((big[:, i] * big[:, j]).sum()) for i in range(5) for j in range(i, 5))
    x = np.array([[np.iinfo(np.int64).max], [np.iinfo(np.int64).min]])
    assert scatter(x)[1][0, 0] == int(x[0, 0]) ** 2 + int(x[1, 0]) ** 2
    assert bit_planes(np.array([[5], [1], [4]], dtype=np.uint64))[:, :, 0].tolist() == [[0b011, 0, 0b101]]


def brute(vectors):
    """Distinct integer vectors, n, S and the exact covariance."""
    x = sorted({tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = len(sums)
    v = [[Fraction(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j], n * n) for j in range(d)] for i in range(d)]
    return np.array(x), n, sums, v


def check(out, ids, vectors, components=4):
    x, n, sums, v = brute(vectors)
    values, axes = np.linalg.eigh(np.array(v, dtype=float))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    centre = np.array([float(Fraction(s, n)) for s in sums])
    trace = float(sum(v[i][i] for i in range(len(sums))))
    want = {i: np.floor(256 * np.array(r, dtype=float)) for i, r in zip(ids, vectors)}
    signs = {}
    assert len(out) == len(ids) * len(values)
    for r in out.itertuples():
        k, own = r.component - 1, want[r.vec_id]
        assert r.n == n and int(r.deviation) == sum((n * int(c) - s) ** 2 for c, s in zip(own, sums))
        assert r.explained == pytest.approx(values[k] / trace, rel=1e-9)
        assert r.identity_error < 1e-9
        w = float((own - centre) @ axes[:, k] / np.sqrt(values[k]))
        assert abs(r.whitened) == pytest.approx(abs(w), abs=1e-8)
        if abs(w) > 1e-6:
            assert signs.setdefault(k, np.sign(w * r.whitened)) == np.sign(w * r.whitened)


def test_query(spark):
    rows = spark.read.parquet(f"{SF001}/embeddings.parquet").toPandas()
    out = entry.queries()["op11_whitening"](spark, SF001)
    assert dict(out.dtypes)["deviation"] == "bigint" and dict(out.dtypes)["component"] == "int"
    check(out.toPandas(), rows.vec_id.tolist(), rows.embedding.tolist())


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)]
    good += [(100, good[0][1]), (101, [c + 1e-9 for c in good[0][1]]), (102, [1e3, -1e3, 3e2]), (None, [0.5, -0.0, 0.25])]
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0]), (203, [float("inf"), 0.0, 0.0]),
           (204, [1.0, 2.0]), (205, [])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("dims", F.lit(1))
    out = whiten(df, keep=("vec_id", "x", "dims")).toPandas()
    assert set(out.x) == {"clash"} and out.vec_id.isna().sum() == 3
    named = out.assign(vec_id=out.vec_id.fillna(-1).astype(int))
    check(named, [-1 if i is None else i for i, _ in good], [v for _, v in good], components=3)


def test_flat_single_and_empty(spark):
    kind = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], kind)).toPandas()
    assert len(one) == 4 and one.whitened.isna().all() and (one.deviation == 0).all() and one.identity_error.isna().all()
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], kind)).toPandas()
    assert line[line.component == 1].whitened.notna().all() and line[line.component > 1].whitened.isna().all()
    assert line.explained.max() == pytest.approx(1) and line.identity_error.max() < 1e-9


def test_huge_entries(spark):
    rows = [(i, [float(s) * 2.0 ** e, float(i)]) for i, (s, e) in enumerate([(1, 40), (-1, 50), (1, 1000), (-1, 1000), (3, 20)])]
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert len(out) == 10 and out[out.component == 1].whitened.notna().all()
