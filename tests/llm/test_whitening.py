"""Whitening against covariances worked out with Python's whole numbers."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, N string, other long"


def brute(rows):
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in rows]
    n, size = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(size)]
    z = [[n * r[d] - sums[d] for d in range(size)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(size)] for i in range(size)])
    return z, v


@pytest.mark.parametrize("scale", [1.0, 1e12])
def test_components_are_those_of_the_exact_covariance(spark, scale):
    """Also for entries so large that squares need more than 64 bits."""
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((300, 10)) * np.linspace(1, 3, 10)) @ np.linalg.qr(rng.standard_normal((10, 10)))[0] * scale
    good = [[float(c) for c in v] for v in x]
    good += [good[0], good[0]]
    rows = [(i if i % 8 else None, v, "x", i) for i, v in enumerate(good)]
    bad = [None, [], [1.0] * 3, [float("nan")] * 10, [float("inf")] * 10, [None] + [1.0] * 9, [1e300] * 10]
    rows += [(1000 + i, v, "x", 1000 + i) for i, v in enumerate(bad)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(6), 4)
    assert out.columns == ["vec_id", "embedding", "other", "n", "deviation", "whitened", "explained", "identity_error"]
    got = {r["other"]: r for r in out.collect()}
    assert set(got) == set(range(len(good)))
    z, v = brute(good)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:4]
    n = len(good)
    want = (np.array([[c / n for c in r] for r in z]) @ vectors[:, order]) / np.sqrt(values[order])
    w = np.array([got[i]["whitened"] for i in range(n)])
    sign = np.sign((w * want).sum(0))
    assert np.allclose(w, want * sign, rtol=1e-9, atol=1e-9)
    assert np.allclose(got[0]["explained"], values[order] / np.trace(v), rtol=1e-12)
    assert {r["n"] for r in got.values()} == {n} and got[0]["identity_error"] < 1e-10
    assert np.abs(w.T @ w / n - np.eye(4)).max() == pytest.approx(got[0]["identity_error"], abs=1e-12)
    for i in range(n):
        exact = sum(c * c for c in z[i])
        assert got[i]["deviation"] == (exact if exact < 2**63 else None)


def test_sums_of_squares_are_exact():
    rng = np.random.default_rng(2)
    for most in (1000, 2**61):
        y = rng.integers(-most, most, (7, 5))
        rows, columns = whitening.pair_places(5)
        want = [sum((int(r[i]) + (int(r[j]) if i != j else 0)) ** 2 for r in y) for i, j in zip(rows, columns)]
        assert whitening.squared_sums(y).tolist() == want


def test_constant_columns_single_rows_and_empty_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None)])).count() == 0
    one = whitening.whiten(make([(1, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, [], [])]
    flat = whitening.whiten(make([(i, [float(i), 3.0, -float(i)]) for i in range(10)])).collect()
    assert all(len(r["whitened"]) == 1 for r in flat) and flat[0]["explained"][0] == pytest.approx(1.0)
    assert flat[0]["identity_error"] < 1e-12


def test_longest_of_equally_frequent_lengths_stays(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r["vec_id"] for r in whitening.whiten(df).select(F.col("vec_id")).collect()} == {3, 4}
