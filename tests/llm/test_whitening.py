"""Whitening against a plain eigenvalue decomposition and exact integers."""

import math

import numpy as np
import pytest

from ragscope.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, x int, n string, component double"


def spectra():
    rng = np.random.default_rng(7)
    yield rng.uniform(1, 2, 24)
    yield 10.0 ** rng.uniform(-6, 3, 24)
    yield np.array([5.0] * 4 + [1.0] * 20)
    yield np.array([1e6, *rng.uniform(0.1, 0.2, 23)])
    yield np.array([3.0, 2.0, 1.0] + [0.0] * 21)
    yield np.ones(24)
    yield np.concatenate((rng.uniform(1, 1.0001, 12), rng.uniform(0.5, 0.50001, 12)))


@pytest.mark.parametrize("spectrum", list(spectra()))
def test_components(spectrum):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    v = q * spectrum @ q.T
    values, vectors = wh.components(v, 10)
    want = np.sort(spectrum)[::-1][:10]
    scale = spectrum.max()
    assert np.allclose(values, want, rtol=0, atol=1e-13 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-13)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * scale
    reference, basis = np.linalg.eigh(v)
    for k in range(10):  # where an eigenvalue stands alone, so does its eigenvector
        gap = np.sort(np.abs(np.sort(spectrum)[::-1] - want[k]))[1]
        if gap > 1e-6 * scale:
            assert abs(abs(basis[:, -1 - k] @ vectors[:, k]) - 1) < 1e-13


def test_polar_factor():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    u = wh.polar(a)
    values, q = np.linalg.eigh(a)
    assert np.abs(u - q * np.sign(values) @ q.T).max() < 1e-13


def rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) / 3
    out = [(i, v.tolist()) for i, v in enumerate(base)]
    out += [(1000 + i, base[5].tolist()) for i in range(150)]  # copies
    out += [(7, base[9].tolist()), (None, base[11].tolist()), (5000, None), (5001, [None] + [1.0] * 19), (5002, [math.nan] * 20),
            (5003, [math.inf] + [0.0] * 19), (5004, []), (5005, [1.0] * 19), (5006, [0.0] * 20)]
    return out


def brute(table, length):
    usable = [(i, v) for i, v in table if v and len(v) == length and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in usable]
    distinct = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(distinct), distinct.sum(0)
    y = (distinct - 1_000_000).astype(float)
    y -= y.mean(0)
    values, q = np.linalg.eigh(y.T @ y / n)
    return usable, x, n, [int(s) for s in sums], values[::-1], q[:, ::-1]


def test_against_brute_force(spark):
    table = rows()
    docs = spark.createDataFrame([(i, v, 1, 2, "n", 0.5) for i, v in table], SCHEMA).repartition(5)
    got = wh.whitened_rows(docs).collect()
    usable, x, n, sums, values, q = brute(table, 20)
    assert len(got) == 16 * len(usable)
    want = {}
    for (i, _), row in zip(usable, x):
        dev = sum((n * a - s) ** 2 for a, s in zip(row, sums))
        proj = np.array([(a * n - s) / n for a, s in zip(row, sums)]) @ q[:, :16] / np.sqrt(values[:16])
        want.setdefault(i, []).append((dev, proj))
    sign = {}
    for r in got:
        k = r.component - 1
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9
        match = [p for d, p in want[r.vec_id] if d == r.deviation]
        assert match
        if abs(r.whitened) > 0.1:
            sign.setdefault(k, round(math.copysign(1, r.whitened * match[0][k])))
        assert abs(abs(r.whitened) - abs(match[0][k])) < 1e-8
        if abs(r.whitened) > 0.1:
            assert r.whitened * match[0][k] * sign[k] > 0  # one sign for all rows


def test_tables_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert wh.whitened_rows(spark.createDataFrame([], schema)).count() == 0
    assert wh.whitened_rows(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert wh.whitened_rows(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)).count() == 0
    # two distinct vectors: one component, and the copies count once
    got = wh.whitened_rows(spark.createDataFrame([(i, [1.0, 2.0] if i else [3.0, 2.0]) for i in range(5)], schema)).collect()
    assert len(got) == 5 and {r.component for r in got} == {1} and {r.n for r in got} == {2}
    assert all(abs(abs(r.whitened) - 1) < 1e-12 for r in got)


def test_deviation_is_exact_or_null():
    rng = np.random.default_rng(4)
    for n, size in ((5, 100), (10**6, 3000), (10**8, 30), (10**13, 10**6), (3, 1 << 60)):
        x = rng.integers(-size, size, (50, 8)) + 1_000_000
        sums = [int(s) * n // 50 for s in x.astype(object).sum(0)]
        want = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
        assert wh.deviation(x, n, sums) == [w if w < 1 << 63 else None for w in want]


def test_query(spark):
    from tests.conftest import SF01
    got = wh.op12_whitening(spark, SF01)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                                "whitened": "double", "explained": "double", "identity_error": "double"}
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    usable, x, n, sums, values, q = brute(table, 64)
    got = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(got) == 16 * len(usable)
    for (i, _), row in zip(usable, x):
        proj = np.array([(a * n - s) / n for a, s in zip(row, sums)]) @ q[:, :16] / np.sqrt(values[:16])
        for k in range(16):
            r = got[i, k + 1]
            assert (r.n, r.deviation) == (n, sum((n * a - s) ** 2 for a, s in zip(row, sums)))
            assert abs(abs(r.whitened) - abs(proj[k])) < 1e-8 and r.identity_error < 1e-9
