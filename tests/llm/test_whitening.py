from fractions import Fraction

import numpy as np
import pytest

from concord.llm import whitening
from concord.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n int, d string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 5, "d") for i, v in rows], SCHEMA)


def exact(vectors):
    """(n, sums, covariance as fractions of whole numbers) of the distinct vectors."""
    fit = sorted(set(vectors))
    n, d = len(fit), len(fit[0])
    s = [sum(v[k] for v in fit) for k in range(d)]
    m = [[n * sum(v[a] * v[b] for v in fit) - s[a] * s[b] for b in range(d)] for a in range(d)]
    return n, s, m


def checked(got, vectors, components=4):
    """got: (x, row) of every vector. Compares with the exact covariance."""
    n, s, m = exact(vectors)
    d = len(s)
    v = np.array([[float(Fraction(a, n * n)) for a in r] for r in m])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(Fraction(sum(m[k][k] for k in range(d)), n * n))
    off = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, s, strict=True)] for x, _ in got])
    w = np.array([r.whitened for _, r in got], float)
    for k in range(min(components, d)):
        want = off @ axes[:, k] / np.sqrt(values[k])
        assert np.allclose(w[:, k], want, atol=1e-7) or np.allclose(w[:, k], -want, atol=1e-7)
    for x, r in got:
        assert r.n == n and int(r.deviation) == sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True))
        assert np.allclose(r.explained, values[:components] / trace, rtol=1e-9)
        assert 0 <= r.identity_error < 1e-9


def test_against_exact_fractions(spark):
    path = "/root/testdata/sf0.001"
    src = {r.vec_id: tuple(int(np.floor(256 * float(c))) for c in r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()}
    rows = whitening.whitened(spark.read.parquet(f"{path}/embeddings.parquet")).collect()
    assert {r.vec_id for r in rows} == set(src)
    checked([(src[r.vec_id], r) for r in rows], src.values())
    query = QUERIES["op11_whitening"](spark, path).collect()
    assert len(query) == 4 * len(rows) and dict(query[0].asDict()).keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    by = {r.vec_id: r for r in rows}
    assert all(q.whitened == by[q.vec_id].whitened[q.component - 1] and q.deviation == int(by[q.vec_id].deviation) for q in query)


@pytest.mark.parametrize("scale", [1.0, 2.0**21, 2.0**45])
def test_large_numbers_with_a_far_mean(spark, scale):
    """Products of up to 108 bits, and a mean 1,000 times the spread: floating sums would lose everything."""
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((300, 6)) * [5, 4, 3, 2, 1, 1] + 1000) * scale / 256
    vectors = [tuple(int(np.floor(256 * c)) for c in r) for r in v.tolist()]
    rows = whitening.whitened(frame(spark, [(k, r) for k, r in enumerate(v.tolist())])).collect()
    checked([(vectors[r.vec_id], r) for r in rows], vectors)


def test_graded_spreads(spark):
    """The fourth component has 1e-12 of the first one's variance and still has variance 1 afterwards."""
    v = np.random.default_rng(5).standard_normal((500, 5)) * [1e9, 1e6, 3e4, 1e3, 1] @ np.linalg.qr(np.random.default_rng(6).standard_normal((5, 5)))[0]
    rows = whitening.whitened(frame(spark, [(k, r) for k, r in enumerate(v.tolist())])).collect()
    w = np.array([r.whitened for r in rows])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-6 and max(r.identity_error for r in rows) < 1e-6


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [-0.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [0.25]), (8, [1e300, 0.0, 1.0]), (9, [-1e300, 0.0, 1.0])]
    got = {}
    for r in whitening.whitened(frame(spark, rows)).collect():
        got.setdefault(r.vec_id, []).append(r)
    assert set(got) == {1, None, 6, 7, 8, 9} and len(got[1]) == 2 and got[1][0] == got[1][1]
    assert got[1][0].n == 2 and abs(abs(got[1][0].whitened[0]) - 1) < 1e-12 and got[1][0].whitened[1] is None
    assert got[1][0].explained[1] == 0 and abs(got[1][0].explained[0] - 1) < 1e-12 and got[1][0].identity_error < 1e-12
    assert int(got[1][0].deviation) == (2 * 128 - 128) ** 2 + (2 * 256 - 768) ** 2
    assert got[6][0].whitened == [] and got[6][0].deviation == "0"
    assert got[7][0].whitened == [None] and got[7][0].identity_error is None and got[7][0].explained == [0.0]
    assert got[8][0].deviation == str((2 * (2**63 - 1) - (-1)) ** 2) and got[9][0].n == 2  # at a long's ends
    assert whitening.whitened(frame(spark, rows).limit(0)).count() == 0


def test_sums_leave_the_driver_alone(spark):
    """What tasks hand on are sums by pair of dimensions, combined before they are shuffled."""
    x = np.random.default_rng(1).integers(-(2**40), 2**40, (5000, 3))
    sums, products = whitening.scatter(x)
    big = x.astype(object)
    assert (sums == big.sum(0)).all() and (products == big.T @ big).all()
