import random

import numpy as np
import pytest

from tallyforge.llm import components, jaccard, signature_tree

SCHEMA = "doc_id long, text string, source string, keys string, row_id int, component_id string, chunk int"


def shingles(text):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same or sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, None, "k", 1, "c", 0) for d, t in rows], SCHEMA)
    return sorted(map(tuple, jaccard.jaccard_groups(docs, **options).collect()), key=str)


def made(seed, groups=12):
    rng = random.Random(seed)
    rows = []
    line = " ".join(f"Common{i}" for i in range(9))
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 5, 8, 40, 150]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = [w if rng.random() > rng.choice([0, 0.01, 0.04]) else w.upper() + "x" * rng.randint(0, 1)
                    for w in base]
            if rng.random() < 0.3:
                copy += line.split()
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"docs_per_chunk": 7, "node_sets": 3}])
def test_equals_brute_force(spark, options):
    rows = made(4) + [(1, None), (2, ""), (4, " \n "), (5, "one two"), (7, "ONE two"), (8, "one two three"),
                      (10, "a " * 30_000)]
    rows += [(11, rows[3][1]), (13, rows[3][1]), (6, rows[9][1] + " end"), (6, "another text of the same id here"),
             (None, rows[3][1]), (None, "alone without an id here"), (None, "alone without an id here")]
    assert run(spark, rows, **options) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_tree_connects_like_all_pairs():
    rng = np.random.default_rng(0)
    keys = []
    for _ in range(25):
        base = np.unique(rng.integers(0, 2**63, rng.integers(3, 300)).astype(np.uint64))
        for _ in range(rng.integers(1, 12)):
            keys.append(base[rng.random(len(base)) > rng.choice([0.0, 0.02, 0.1, 0.2])])
    n = len(keys)
    got, want = (signature_tree.Forest(np.arange(n)) for _ in range(2))
    for i, j in signature_tree.links(keys, np.arange(n), None, 75):
        got.join(i, j)
    for i in range(n):
        for j in range(i):
            both = len(np.intersect1d(keys[i], keys[j]))
            if len(keys[i]) and 100 * both >= 75 * (len(keys[i]) + len(keys[j]) - both):
                want.join(i, j)
    assert [got.root(i) for i in range(n)] == [want.root(i) for i in range(n)]


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(
        spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(41)}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_a_large_group_that_links_only_in_a_chain(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1000 - i, " ".join(words[6 * i:6 * i + 60])) for i in range(57)]
    got = run(spark, rows, docs_per_chunk=9, node_sets=3)
    assert got == brute(rows) and {r[2] for r in got} == {944}


def test_a_common_passage_names_no_pairs_that_cannot_link(spark, monkeypatch):
    """Texts that share most shingles but stay below the threshold: what is named does not grow with their square."""
    named = []

    def counted(df):
        out = stage(df)
        if "node_2" in out.columns:
            named.append(out.count())
        return out

    stage = jaccard.stage
    monkeypatch.setattr(jaccard, "stage", counted)
    common = [f"c{i}" for i in range(100)]
    rows = [(i, " ".join(common + [f"own{i}x{k}" for k in range(22)])) for i in range(40)]
    assert [r[2] for r in run(spark, rows, node_sets=2)] == sorted(range(40), key=str)
    assert named and max(named) <= 40
    # One word less that is not shared, and some pairs link.
    rows = [(i, " ".join(common + [f"own{i}x{k}" for k in range(14 + i % 9)])) for i in range(30)]
    assert run(spark, rows, node_sets=2, docs_per_chunk=8) == brute(rows)
