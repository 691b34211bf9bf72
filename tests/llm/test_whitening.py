import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewise.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, whitened string, n int"


def brute(vectors):
    """n, deviations, whitened, eigenvalues, trace; all from Python integers with the offset left in."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], object)
    n, total = len(x), x.sum(axis=0)
    exact = n * x.T.dot(x) - np.outer(total, total)
    v = np.array([[a / (n * n) for a in row] for row in exact.tolist()])
    values, vectors = (a[..., ::-1] for a in np.linalg.eigh(v))
    centred = n * x - total
    z = np.array([[a / n for a in row] for row in centred.tolist()]) @ vectors[:, :32]
    return n, (centred * centred).sum(axis=1), z, values[:32], np.trace(v)


def test_against_integers(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) * rng.choice([1e-1, 1, 30], 40)).tolist()
    rows = [(k, v, "x", 1) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r["vec_id"], r["component"]): r for r in whitening.digest(df).collect()}
    n, deviation, z, values, trace = brute(vectors)
    assert len(got) == 300 * 32
    for k in range(300):
        assert {got[k, c]["deviation"] for c in range(1, 33)} == {deviation[k]} and {got[k, c]["n"] for c in range(1, 33)} == {n}
    for c in range(32):
        mine = np.array([got[k, c + 1]["whitened"] for k in range(300)])
        want = z[:, c] / np.sqrt(values[c])
        assert np.abs(mine * np.sign(mine @ want) - want).max() < 1e-8
        assert got[0, c + 1]["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
    assert got[0, 1]["identity_error"] < 1e-9


def test_far_smaller_than_the_shift_and_the_largest(spark):
    """Variances of 1 beside entries of 10**12: floats would lose them."""
    rng = np.random.default_rng(6)
    vectors = [[1e12 + a, float(b), -3e9 + c / 64] for a, b, c in rng.integers(-3, 4, (200, 3)).tolist()]
    got = whitening.digest(spark.createDataFrame([(k, v, None, 1) for k, v in enumerate(vectors)], SCHEMA)).collect()
    _, deviation, _, values, trace = brute(vectors)
    assert {r["vec_id"]: r["deviation"] for r in got} == dict(enumerate(deviation))
    assert max(r["identity_error"] for r in got) < 1e-9
    assert sorted({r["explained"] for r in got}) == pytest.approx(sorted(values / trace), rel=1e-9)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(-(1 << 51), 1 << 51), min_size=3, max_size=3), min_size=1, max_size=20))
def test_scatter_is_exact(rows):
    x = np.array(rows, np.int64)
    sums, cross = whitening.scatter(x)
    assert sums.tolist() == [sum(c) for c in zip(*rows)]
    assert cross.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
    assert all(sum(p << (whitening.LIMB * k) for k, p in whitening._limbs(int(v))) == v for v in cross.ravel())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (7, [-1.0, 0.25])]
    bad = [(2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (8, [1.0, 2.0, 3.0])]
    got = whitening.digest(spark.createDataFrame([(k, v, None, 1) for k, v in good + bad], SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (7, 1), (7, 2)]
    assert {r["n"] for r in got} == {4}
    assert {(r["vec_id"], r["deviation"]) for r in got} == set(zip([k for k, _ in good], brute([v for _, v in good])[1]))
    assert whitening.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = whitening.digest(spark.createDataFrame([(1, [2.0, 5.0], None, 1)], SCHEMA)).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(0, None, 0.0, 0.0)] * 2
    flat = whitening.digest(spark.createDataFrame([(k, [float(k), 7.0, 2.0 * k], None, 1) for k in range(9)], SCHEMA)).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True), (3, True)} and max(r["identity_error"] for r in flat) < 1e-9
    huge = whitening.digest(spark.createDataFrame([(k, [k * 1e30, 1.0 * k * k], None, 1) for k in range(5)], SCHEMA)).collect()
    assert len(huge) == 10 and all(r["deviation"] is None for r in huge if r["vec_id"] != 2)
