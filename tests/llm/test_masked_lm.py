import random

import numpy as np
import pyarrow as pa

from tallyforge.llm import masked_lm as lm
from tallyforge.llm import words

SCHEMA = "doc_id long, text string, n_tokens int, word string, n string"


def vocabulary(texts):
    w = list(words.words_of(pa.array(texts, pa.string()), lower=True))[0]
    key, n = np.unique(w.hash, return_counts=True)
    order = np.argsort(-n, kind="stable")[:50]
    return lm.Vocabulary(key[order], n[order].astype(float), np.zeros(lm.RARE_IDS)), w


def random_weights(v):
    rng = np.random.default_rng(1)
    w = lm.start_weights(v)
    return {k: (x + rng.normal(0, 0.2, x.shape)).astype(np.float64) for k, x in w.items()}


def test_probabilities_sum_to_one_and_match_a_plain_softmax():
    v, w = vocabulary(["a b c d e f a b c", "x", "g h"])
    weights = random_weights(v)
    ids = v.ids(w.hash)
    around = lm.contexts(ids, w.count)
    assert (around[9] == lm.IDS).all() and around[0].tolist() == [lm.IDS, lm.IDS, ids[1], ids[2]]
    got = lm.log_probabilities(weights, ids, around)
    for i in (0, 4, 9, 10):
        h = np.tanh(weights["bias"] + sum(weights["embed"][around[i, k]] * weights["place"][k] for k in range(4)))
        outer = np.exp(weights["class_w"] @ h + weights["class_b"])
        inner = np.exp(weights["word_w"] @ h + weights["word_b"])
        p = (outer / outer.sum())[:, None] * inner / inner.sum(axis=1, keepdims=True)
        assert abs(p.sum() - 1) < 1e-9
        assert abs(np.log(p[ids[i] % lm.CLASSES, ids[i] // lm.CLASSES]) - got[i]) < 1e-6


def test_gradients_agree_with_differences():
    v, w = vocabulary(["a b c d e f a b c k l m", "x y a b"])
    weights = random_weights(v)
    ids = v.ids(w.hash)
    around = lm.contexts(ids, w.count)
    for name, g in lm.gradients(weights, ids, around).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = weights[name][at]
        loss = []
        for step in (1e-4, -1e-4):
            weights[name][at] = old + step
            loss.append(-lm.log_probabilities(weights, ids, around).mean())
        weights[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-4 - g[at]) < 1e-3 * abs(g[at]) + 1e-6


def grammar(n, seed):
    rng = random.Random(seed)
    subjects, verbs, objects = (["s%d" % i for i in range(20)], ["v%d" % i for i in range(20)], ["o%d" % i for i in range(20)])
    return [" ".join(x for _ in range(rng.randint(5, 40)) for x in (rng.choice(subjects), rng.choice(verbs), rng.choice(objects)))
            for _ in range(n)]


def test_trained_scores_prefer_text_in_order(spark):
    texts = grammar(1500, 1)
    docs = spark.createDataFrame([(i, t, 1, "w", "n") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    v = lm.learn_vocabulary(docs)
    weights = lm.train(docs, v, share=2)
    held = grammar(60, 2)
    mixed = [" ".join(random.Random(3).sample(t.split(), len(t.split()))) for t in held]
    rows = [(i, t, 1, "w", "n") for i, t in enumerate(held + mixed)]
    got = {r.doc_id: r.mean_log_prob for r in lm.score_documents(spark.createDataFrame(rows, SCHEMA), v, weights).collect()}
    assert np.mean([got[i] > got[60 + i] for i in range(60)]) > 0.9
    assert np.mean([got[i] for i in range(60)]) > np.log(1 / 60) + 0.5


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Word"), (4, "Word"), (None, "w " * 50_000), (6, "z" * 100_000)]
    docs = spark.createDataFrame([(i, t, 1, "w", "n") for i, t in rows], SCHEMA)
    got = lm.score_documents(docs).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 0 and by[1].log_prob == 0 and by[2].mean_log_prob is None
    assert by[4].n_tokens == by[6].n_tokens == 1 and by[None].n_tokens == 50_000 and by[None].log_prob < 0
    assert lm.score_documents(docs.limit(0)).collect() == []


def test_rare_words_have_their_own_share_of_a_shared_id(spark, monkeypatch):
    monkeypatch.setattr(lm, "IDS", lm.RARE_IDS + 3)
    texts = ["a b c"] * 30 + ["seldom once%d often often" % i for i in range(6)]
    docs = spark.createDataFrame([(i, t, 1, "w", "n") for i, t in enumerate(texts)], SCHEMA)
    v = lm.learn_vocabulary(docs)
    monkeypatch.undo()
    v.counts = np.concatenate([v.counts, np.ones(lm.IDS - len(v.counts))])
    weights = lm.start_weights(v)
    for k in ("embed", "class_w", "word_w"):
        weights[k][:] = 0
    asked = ["a", "often", "seldom", "once3", "never"]
    frame = spark.createDataFrame([(i, t, 1, "w", "n") for i, t in enumerate(asked)], SCHEMA)
    got = {asked[r.doc_id]: np.exp(r.log_prob) for r in lm.score_documents(frame, v, weights).collect()}
    total = v.counts.sum()
    for word, n in (("a", 31), ("often", 12), ("seldom", 6), ("once3", 1), ("never", 1)):
        assert abs(got[word] * total - n) < 1e-3 * n


def test_every_window_trains(spark):
    for word in ("one", "two", "three", "four"):
        docs = spark.createDataFrame([(1, word, 1, "w", "n")], SCHEMA)
        v = lm.learn_vocabulary(docs)
        start, got = lm.start_weights(v), lm.train(docs, v)
        assert (got["word_b"] != start["word_b"]).any()


def test_a_step_adds_no_rows_one_by_one(monkeypatch):
    """Gradients of the inputs are summed by sorted rows, and equal a plain sum."""
    v, w = vocabulary(["a b c d e f a b c k l m", "x y a b"] * 9)
    weights = random_weights(v)
    ids = v.ids(w.hash)
    around = lm.contexts(ids, w.count)
    rng = np.random.default_rng(2)
    values, want = rng.normal(size=(around.size, lm.WIDTH)), np.zeros((lm.IDS + 1, lm.WIDTH))
    for row, value in zip(around.ravel().tolist(), values):
        want[row] += value
    assert np.allclose(lm._row_sums(around.ravel(), values, lm.IDS + 1), want)
    calls = []
    monkeypatch.setattr(lm.np, "exp", lambda *a, f=np.exp, **b: calls.append(a[0].shape) or f(*a, **b))
    lm.gradients(weights, ids, around)
    # Every softmax takes the exponentials of its scores once.
    assert sum(n for n, _ in calls) == 2 * len(ids)
