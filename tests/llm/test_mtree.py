import numpy as np
import pytest

from tallyforge.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, label int, score string, region int, v string"


def brute(rows, k=10):
    seen = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            x = np.zeros(8, np.int64)
            x[:len(e)] = np.floor(1024.0 * np.array(e, np.float32).astype(float)).astype(np.int64)
            seen[(i, x.tobytes())] = x
    out = []
    for (q, _), x in seen.items():
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for (i, _), y in seen.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, e, 1, "s", 2, "v") for i, e in rows], SCHEMA)
    return sorted(map(tuple, mtree.top_products(df, **options).collect()))


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, 8))
    return [(i, (centers[i % 9] * rng.choice([0.5, 1, 2]) + rng.normal(size=8) * rng.choice([0, 0.1, 1])).tolist())
            for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"group_vectors": 60, "queries_per_block": 4}])
def test_equals_brute_force(spark, options):
    rows = made(900)
    rows += [(1000 + i, rows[5][1]) for i in range(150)]
    rows += [(3, None), (7, [1.0, None] * 4), (100, [float("nan")] * 8), (8, [float("inf")] * 8), (None, [1.0] * 8),
             (300, [0.0] * 8), (5, rows[5][1]), (2001, [2.0, 1.0]), (2100, [])]
    assert run(spark, rows, **options) == brute(rows)


def test_few_rows_and_none(spark):
    assert run(spark, []) == run(spark, [(1, None)]) == run(spark, [(100, [1.0])]) == []
    rows = [(0, [1.0, 2.0]), (5, [0.5, 0.5]), (6, [-3.0, 1.0])]
    assert run(spark, rows) == brute(rows)


def test_tree_visits_part_of_its_pages(monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 16)) * 1000
    v = np.concatenate([np.rint(c + rng.normal(size=(100, 16)) * 20) for c in centers]).astype(np.int64)
    square = float((v.astype(float) ** 2).sum(axis=1).max())
    tree = mtree.MTree(np.arange(len(v)), v, square)
    read = []
    for q in range(0, 400, 40):
        got = tree.search(v[q], q, 10, -np.inf)
        want = sorted((-int(v[q] @ v[i]), i) for i in range(len(v)) if i != q)[:10]
        assert got == [(-s, i) for s, i in want]
        read.append(len(got))
    leaves = np.concatenate([r for r in tree.rows if r is not None])
    assert sorted(leaves.tolist()) == list(range(len(v)))
    for node, rows in enumerate(tree.rows):
        if rows is not None:
            assert (tree._far(tree.center[node], rows) <= tree.radius[node] + 1e-9).all()
