"""Operator 13."""

from fractions import Fraction

import numpy as np
import pytest
from conftest import SF

import __spark_entry__ as entry
from panelcast.llm import whitening


def plain_covariance(x):
    """Centred products as fractions."""
    n, out = len(x), np.empty((len(x[0]),) * 2)
    mean = [Fraction(sum(r[a] for r in x), n) for a in range(len(x[0]))]
    for a in range(len(mean)):
        for b in range(len(mean)):
            out[a, b] = float(sum((r[a] - mean[a]) * (r[b] - mean[b]) for r in x) / n)
    return out


def check(rows, vectors, k=4):
    """``rows`` against the definition on ``vectors`` (id, list or None), ids unique."""
    kept = {i: [int(np.floor(256 * float(c))) for c in v] for i, v in vectors
            if v and all(c is not None and np.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, kept.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = plain_covariance(fit)
    value, unit = np.linalg.eigh(cov)
    value, unit = value[::-1], unit[:, ::-1]
    k = min(k, len(sums))
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(kept) and len(rows) == k * len(kept)
    signs = {}
    for i, x in kept.items():
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        for c in range(1, k + 1):
            r = by[i][c]
            assert (r.n, r.deviation) == (n, dev if dev < 2 ** 63 else None)
            assert np.isclose(r.explained, value[c - 1] / np.trace(cov), rtol=1e-9)
            want = centred @ unit[:, c - 1] / np.sqrt(value[c - 1])
            if abs(want) > 1e-3:
                assert signs.setdefault(c, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
            assert np.isclose(abs(r.whitened), abs(want), rtol=1e-7, atol=1e-7)
    w = np.array([[by[i][c].whitened for c in range(1, k + 1)] for i in {tuple(x): i for i, x in kept.items()}.values()])
    got = np.abs(np.cov(w.T, bias=True) - np.eye(k)).max()
    assert abs(got - rows[0].identity_error) < 1e-9 and got < 1e-6


def test_query_by_definition(spark):
    rows = entry.queries()["op13_polarisation_whitening"](spark, SF).collect()
    check(rows, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(c) for c in rng.normal(size=5) @ np.diag([1, 2, 3, 4, 5]) + 1000]) for i in range(60)]
    vectors += [(100 + i, vectors[0][1]) for i in range(20)]                               # copies count once
    vectors += [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * 5), (203, [float("inf")] + [0.0] * 4),
                (204, []), (205, [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<double>, component int, _x string")
    check(whitening.whiten(df).collect(), vectors)
    other = df.union(spark.createDataFrame([(300, [1.0, 2.0], 1, "x")], df.schema))        # of another length: left out
    assert whitening.whiten(other).count() == whitening.whiten(df).count()
    assert whitening.whiten(df.limit(0)).collect() == []
    null_id = spark.createDataFrame([(None, [1.0, 2.0]), (1, [2.0, 5.0]), (1, [2.0, 5.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(null_id).collect()
    assert len(got) == 6 and {r.n for r in got} == {2} and {r.component for r in got} == {1, 2}
    assert all((r.whitened is None) == (r.component == 2) for r in got)                    # two points lie on a line


def test_sums_beyond_64_bits_stay_exact(spark):
    big = [[3e15, -2e14, 5.0], [2.9e15, 1e14, 7.0], [-1e15, 3e15, 1.0], [1e300, 0.0, 1.0], [1e12, 2e12, 3.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    x = [[min(max(int(np.floor(256 * c)) if abs(c) < 1e16 else int(256 * c), -2 ** 63), 2 ** 63 - 1) for c in v] for v in big]
    assert list(model.sums) == [sum(c) for c in zip(*x)]
    assert np.allclose(model.covariance, plain_covariance(x), rtol=1e-14)
    assert all(r.deviation is None for r in whitening.whiten(df).where("vec_id = 3").collect())


def test_constant_vectors_have_no_component_values(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    rows = whitening.whiten(df).collect()
    assert len(rows) == 8 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in rows)


@pytest.mark.parametrize("n", [2, 3, 50])
def test_polarisation_equals_products(n):
    rng = np.random.default_rng(n)
    x = [[int(v) for v in row] for row in rng.integers(-10 ** 6, 10 ** 6, (n, 7))]
    sums = [sum(c) for c in zip(*x)]
    mid = [s // n for s in sums]
    y, square, at = np.array(x) - np.array(mid), {}, 0
    for a in range(7):
        for v in whitening.squares(y, a):
            square[at] = int(v)
            at += 1
    assert np.allclose(whitening.covariance(n, sums, mid, square), plain_covariance(x), rtol=1e-15)
