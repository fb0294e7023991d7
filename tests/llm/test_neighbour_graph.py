import numpy as np
import pytest

from tallyforge.llm import neighbour_graph as ng

SCHEMA = "vec_id long, embedding array<float>, label int, node string, v int, id string"


def made(seed, n=500, width=12):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        c = rng.normal(size=width)
        for _ in range(rng.choice([1, 1, 1, 2, 5, 60])):
            rows.append((len(rows) * 2, (c + rng.normal(size=width) * rng.choice([0, 0.1, 0.2])).tolist()))
    return rows


def brute(rows, least=0.9):
    x = [np.array(e, np.float32).astype(float) if i is not None and e and all(
        v is not None and np.isfinite(v) for v in e) else None for i, e in rows]
    width = max((len(v) for v in x if v is not None), default=0)
    m = np.array([np.zeros(width) if v is None else np.append(v, np.zeros(width - len(v))) for v in x])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    u = m / np.where(norm > 0, norm, 1)
    like = u @ u.T >= least
    np.fill_diagonal(like, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min(label[j] for j in np.append(np.flatnonzero(like[i]), i)) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    least_id = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least_id[label[i]] = min(v, least_id.get(label[i], v))
    return like, [(v, int(like[i].sum()), least_id.get(label[i])) for i, (v, _) in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"shard_vectors": 150}])
def test_recall_and_no_false_links(spark, options):
    rows = made(1) + [(2001 + 2 * i, made(1)[3][1]) for i in range(40)]
    rows += [(3001, None), (3003, []), (3005, [0.0] * 12), (3007, [1.0, None]), (3009, [float("nan")] * 12),
             (3011, [1.0]), (None, made(1)[3][1])]
    df = spark.createDataFrame([(i, e, 1, "n", 2, "x") for i, e in rows], SCHEMA)
    got = ng.near_duplicates(df, **options).collect()
    assert len(got) == len(rows)
    _, want = brute(rows)
    truth = {v: (n, c) for v, n, c in want}
    assert all(r.n_links <= truth[r.vec_id][0] for r in got)
    assert sum(r.n_links for r in got) >= 0.95 * sum(n for _, n, _ in want)
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in got)
    assert np.mean([r.component_id == truth[r.vec_id][1] for r in got]) > 0.97


def test_empty_and_alone(spark):
    assert ng.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(4, [1.0, 0.0], 1, "", 1, ""), (4, [0.0, 1.0], 1, "", 1, "")], SCHEMA)
    assert [tuple(r) for r in ng.near_duplicates(df).collect()] == [(4, 0, 4, True)] * 2


def test_search_finds_what_is_in_range():
    x = np.array([e for _, e in made(2)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, v = ng.range_search(x, ng.shard_edges(x, 0), np.arange(len(x)), 0.9)
    like = x @ x.T >= 0.9
    np.fill_diagonal(like, False)
    assert like[q, v].all() and len(set(zip(q.tolist(), v.tolist()))) == len(q) >= 0.97 * like.sum()


def test_group_larger_than_a_shard_is_counted_whole(spark):
    rng = np.random.default_rng(4)
    c = rng.normal(size=12)
    rows = [(i, (c + rng.normal(size=12) * 0.1).tolist()) for i in range(700)]
    rows += [(1000 + i, e) for i, e in made(5, 300)] + [(5000 + i, [float(i + 1)] * 12) for i in range(500)]
    df = spark.createDataFrame([(i, e, 1, "n", 2, "x") for i, e in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in ng.near_duplicates(df, shard_vectors=64).collect()}
    _, want = brute(rows)
    big = [w for w in want if w[1] >= 400]
    assert len(big) >= 1000 and all(got[v] == (n, label) for v, n, label in big)


def test_below_the_wanted_recall_all_are_compared(spark):
    rows = made(6, 300)
    df = spark.createDataFrame([(i, e, 1, "n", 2, "x") for i, e in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id)
           for r in ng.near_duplicates(df, wanted_recall=1.1, rounds=1, shard_vectors=64).collect()}
    assert got == {v: (n, label) for v, n, label in brute(rows)[1]}


def test_forest_joins_what_the_links_join():
    linked = np.random.default_rng(7).random((60, 80)) < 0.012
    a, b = ng.forest(linked)
    assert linked[a, b].all()

    def labels(pairs):
        label = list(range(140))
        for _ in range(140):
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label

    assert labels(list(zip(a, b + 60))) == labels([(i, j + 60) for i, j in np.argwhere(linked)])
