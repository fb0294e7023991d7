import math

import numpy as np
import pytest

from tallyforge.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, w string, n string, component string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", "y", None) for i, v in rows], SCHEMA).repartition(parts)


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    deviation = [sum(int(t) ** 2 for t in row) for row in (n * x - s).astype(object)]
    return y, e[::-1], u[:, ::-1], deviation


@pytest.mark.parametrize("n, d", [(400, 12), (90, 5), (40, 64), (3, 9)])
def test_equals_a_dense_solver(spark, n, d):
    rng = np.random.default_rng(n)
    vectors = (rng.standard_normal((n, d)) @ np.diag(1.0 / (1 + np.arange(d)))).astype(np.float32).tolist()
    bad = [(1000, None), (1001, [1.0, None] + [0.0] * (d - 2)), (1002, [math.nan] * d), (1003, [math.inf] * d)]
    got = wh.whitened(frame(spark, list(enumerate(vectors)) + bad)).collect()
    y, e, u, deviation = brute(vectors)
    k = min(8, d, n - 1)
    assert len(got) == n * k and {r.vec_id for r in got} == set(range(n))
    cells = {(r.vec_id, r.component): r for r in got}
    for c in range(1, k + 1):
        want = y @ u[:, c - 1] / math.sqrt(e[c - 1])
        mine = np.array([cells[i, c].whitened for i in range(n)])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7
        assert cells[0, c].explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
    assert all(cells[i, 1].deviation == deviation[i] and cells[i, 1].n == n for i in range(n))
    assert 0 <= got[0].identity_error < 1e-8 and len({r.identity_error for r in got}) == 1


def test_ties_repeats_and_missing_ids(spark):
    corners = [[a, b, c, 0.0] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    rows = [(None if i == 3 else i % 5, v) for i, v in enumerate(corners * 2)]
    got = wh.whitened(frame(spark, rows)).collect()
    assert len(got) == 16 * 3 and sum(r.vec_id is None for r in got) == 3
    assert all(abs(r.explained - 1 / 3) < 1e-12 and r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_nothing_varies(spark, rows):
    got = wh.whitened(frame(spark, rows))
    assert got.collect() == [] and got.columns == [f.split()[0] for f in wh.OUT.split(", ")]


def test_shorter_vectors_end_in_zeros(spark):
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(12)]
    cut = [(i, v[:1] if v[1] == 0.0 else v) for i, v in rows]
    first, second = (sorted((r.vec_id, r.component, r.deviation, abs(r.whitened)) for r in wh.whitened(frame(spark, x))
                            .collect()) for x in (rows, cut))
    assert first == second


def test_result_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(8)
    rows = list(enumerate(rng.standard_normal((200, 6)).astype(np.float32).tolist()))
    first, second = (sorted(map(tuple, wh.whitened(frame(spark, x, p)).drop("identity_error").collect()))
                     for x, p in ((rows, 1), (rows[::-1], 5)))
    assert first == second


def test_counts_and_slices():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    values = np.concatenate(([1e6, 1e6 - 1e-3, 500.0, 500.0, 499.999999, 20.0, 3.0, 3.0, 3.0], np.linspace(2, 0, 21)))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    for shift in (0.55, 2.5, 3.5, 499.9999995, 700.0, 2e6, -1.0):
        assert wh.count_above(v, shift) == (values > shift).sum()
    indefinite = v - 400 * np.eye(30)
    for shift in (-399.45, 0.0, 80.0):
        assert wh.count_above(indefinite, shift) == (values - 400 > shift).sum()
    assert wh.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    found = wh.leading(v, 9)
    assert np.allclose([f[0] for f in found], values[:9], rtol=1e-9)
    basis = np.array([f[1] for f in found])
    assert np.abs(basis @ basis.T - np.eye(9)).max() < 1e-10
    assert np.abs(v @ basis.T - basis.T * [f[0] for f in found]).max() < 1e-6
    for k, (value, _, low, high) in enumerate(found, 1):
        assert low <= value + 1e-6 and value - 1e-6 <= high
        assert wh.count_above(v, low) >= k > wh.count_above(v, high)


def test_large_numbers_stay_exact():
    z = np.array([[1 << 30, -3], [-(1 << 30) + 1, 5], [7, 1 << 29]], np.int64)
    want = z.astype(object).T @ z.astype(object)
    assert (wh.products(z) == want).all() and (wh.products(z * 9) == 81 * want).all()
    assert wh._deviations(np.array([[3, 1]]), 1 << 31, np.array([0, 0])) == [None]
    assert wh._deviations(np.array([[1, 0]]), 3, np.array([1, 1])).tolist() == [5]
