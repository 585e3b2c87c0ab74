import math

import numpy as np
import pytest

from rosterlight.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=4):
    """id -> (x, whitened) by numpy's own eigenvectors, with n, sums and the explained shares."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), np.int64)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    return good, n, s.tolist(), e, u


def check(got, rows, k=4):
    good, n, s, e, u = brute(rows)
    assert len(got) == len(good) * k and all(r.n == n for r in got)
    for c in range(k):
        mine = sorted((r.vec_id is None, r.vec_id, r.deviation, r.whitened) for r in got if r.component == c + 1)
        want = sorted((i is None, i, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), float((np.array(x) - np.array(s) / n) @ u[:, c] / math.sqrt(e[c]))) for i, x in good)
        assert [m[:3] for m in mine] == [w[:3] for w in want]
        a, b = np.array([m[3] for m in mine]), np.array([w[3] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert {round(r.explained, 12) for r in got if r.component == c + 1} == {round(e[c] / e.sum(), 12)}
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in (rng.normal(size=d) * np.linspace(1, 3, d)).astype(np.float32)]) for i in range(n)]


def test_equals_brute_force_with_copies_nulls_and_bad_entries(spark):
    rows = vectors(120, 8, 1)
    rows += [(500 + i, rows[7][1]) for i in range(200)] + [(7, rows[7][1])]
    rows += [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] + [0.0] * 7), (904, []), (905, rows[0][1][:7] + [float("-inf")])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(5)
    check(whitening.report(df).collect(), rows)


def test_whole_table_of_tasks_without_rows(spark):
    rows = vectors(9, 5, 3)
    check(whitening.report(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(20)).collect(), rows)


def test_jacobi_keeps_small_eigenvalues_accurate():
    rng = np.random.default_rng(5)
    scale = 10.0 ** -np.arange(0, 12, 1.5)
    a = rng.normal(size=(8, 8)) * 0.1 + np.eye(8)
    core = a @ a.T
    m = core * scale[:, None] * scale[None]
    e, u = whitening.jacobi(m)
    assert (np.diff(e) <= 0).all() and np.abs(u.T @ u - np.eye(8)).max() < 1e-13
    # e_min(core) * scale^2 bounds the least eigenvalue from below, and each diagonal entry bounds it from above
    least, most = np.linalg.eigvalsh(core)[[0, -1]]
    assert least * scale[-1] ** 2 * 0.999 <= e[-1] <= m[-1, -1]
    assert abs(np.prod(e) / np.linalg.det(core) / np.prod(scale**2) - 1) < 1e-10  # the determinant holds only if every one is right
    assert np.abs(m @ u - u * e).max() < 1e-14 * most


@pytest.mark.parametrize("m", [np.zeros((3, 3)), np.array([[2.0]]), np.ones((4, 4)), np.diag([1.0, 3.0, 2.0])])
def test_jacobi_on_degenerate_matrices(m):
    e, u = whitening.jacobi(m)
    assert np.allclose(u @ np.diag(e) @ u.T, m) and np.allclose(e, np.sort(np.linalg.eigvalsh(m))[::-1], atol=1e-12)


def test_no_variance_and_empty_tables(spark):
    flat = spark.createDataFrame([(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)], SCHEMA)
    got = whitening.report(flat).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in sorted(got)] == [(i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 1) for i in range(4)], SCHEMA)
    got = whitening.report(line).collect()
    assert {r.component for r in got} == {1, 2, 3} and all((r.whitened is None) == (r.component > 1) for r in got) and got[0].identity_error < 1e-12
    empty = whitening.report(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == whitening.report(flat).columns


def test_deviation_beyond_a_long_and_clashing_columns(spark):
    wide = spark.createDataFrame([("a", [1e6, -1e6], 1, 2.0), (None, [-1e6, 1e6], 1, 2.0)], "vec_id string, embedding array<double>, n int, whitened double")
    got = sorted(whitening.whitened(wide).where("component = 1").collect(), key=lambda r: r.vec_id or "")
    assert [(r.vec_id, int(r.deviation)) for r in got] == [(None, 2 * (2 * 256 * 10**6) ** 2), ("a", 2 * (2 * 256 * 10**6) ** 2)]
    x = np.array([[1 << 27, 5], [-(1 << 27), 7]], np.int64)
    n, s = 10**10, (10**18, -(10**18))
    assert [int(v) for v in whitening._deviations(x, n, s)] == [sum((n * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]


def test_vectors_of_several_lengths_are_an_error(spark):
    with pytest.raises(ValueError, match="one length"):
        whitening.report(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 1)], SCHEMA))
