"""Whitening against exact fractions, numpy and a high-precision residual."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import whitening
from tessera.llm.whitening import refine, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    return whiten(df, **options).collect()


def scaled(rows):
    keep = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in keep]


def exact_covariance(x):
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    return s, [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("components", [3, 32])
def test_against_exact_fractions(spark, components):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 2), rnd.gauss(5, 1), 0, rnd.gauss(0, 0.5), rnd.gauss(0, 9)]) for i in range(300)]
    rows = [(i, [a, b, a + b * 0.5 + d, d, e]) for i, (a, b, c, d, e) in rows]
    rows += [(7, rows[7][1]), (None, rows[4][1]), (900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]),
             (903, [float("nan")] * 5), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (905, [1.0, 2.0])]
    x = [(i, v) for i, v in scaled(rows) if len(v) == 5]
    got = run(spark, rows, components=components)
    k, n = min(components, 5), len(x)
    assert len(got) == n * k and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    s, cov = exact_covariance([v for _, v in x])
    value, vector = np.linalg.eigh(np.array(cov, float))
    value, vector = value[::-1], vector[:, ::-1]
    by_id = {i: v for i, v in x}
    sign = {}
    for r in got:
        v, c = by_id[r["vec_id"]], r["component"] - 1
        assert r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(v, s))
        want = sum(float(Fraction(n * a - b, n)) * u for a, b, u in zip(v, s, vector[:, c])) / math.sqrt(value[c])
        sign.setdefault(c, 1 if want * r["whitened"] > 0 else -1)
        assert r["whitened"] == pytest.approx(sign[c] * want, abs=1e-8)
        assert r["explained"] == pytest.approx(value[c] / sum(value), rel=1e-10)
        assert r["identity_error"] < 1e-10


def test_refined_vectors_beat_double_precision_also_in_clusters():
    rnd = np.random.default_rng(1)
    q = np.linalg.qr(rnd.normal(size=(24, 24)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q + q @ ((np.eye(24) - q.T @ q) / 2)
    # exact repeats, pairs 1e-9 and 1e-12 apart, and values of very different size
    values = np.array([50, 50, 50, 20, 20 - 1e-9, 10, 10 - 1e-12, 5, 4, 3, 2, 1, 1, 1, .5, .4, .3, .2, .1, 1e-3, 1e-4, 1e-5, 1e-6, 1e-7], np.longdouble)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    start = np.linalg.eigh(a.astype(np.float32))[1]
    assert np.abs(start.T @ start - np.eye(24)).max() > 1e-9  # float32 alone is not enough
    found, x = refine(a, start)
    assert np.abs(x.T @ x - np.eye(24)).max() < 1e-17
    assert np.abs(a @ x - x * found).max() < 1e-16
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-16
    for lo, hi in ((0, 3), (3, 4), (4, 5), (7, 8), (11, 14), (20, 21), (23, 24)):  # the span is what is determined
        limit = 1e-7 if lo in (3, 4) else 1e-12
        assert np.abs(q[:, lo:hi] @ q[:, lo:hi].T - x[:, lo:hi] @ x[:, lo:hi].T).max() < limit


def test_zero_and_single(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [None])]) == []
    one = run(spark, [(5, [1.0, 2.0])])
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    flat = run(spark, [(i, [float(i), 3.0]) for i in range(9)])
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and all(r["identity_error"] < 1e-12 for r in flat)


def test_huge_entries(spark):
    rows = [(i, [float(i), 2.0**40 * (i % 2)]) for i in range(8)] + [(99, [3e38, 0.0])]
    got = run(spark, rows)
    x = [v for i, v in scaled(rows) if i != 99]
    n, s = 8, [sum(r[j] for r in x) for j in range(2)]
    want = {i: sum((n * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    assert {r["vec_id"] for r in got} == set(range(8))
    assert all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 2**63 else None) for r in got)
    assert all(r["identity_error"] < 1e-6 for r in got if r["whitened"] is not None)


def test_products_are_exact():
    rnd = np.random.default_rng(2)
    for size in (3, 10**5, 2**30, 2**40):
        z = rnd.integers(-size, size, (50, 4))
        assert (whitening._products(z) == z.astype(object).T @ z.astype(object)).all()
