import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import ask, substrings

SCHEMA = "doc_id long, text string, source string, chunk string, kept_text int, n_words string"


def brute(rows, window=13):
    starts = {}
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    key = [(d is None, d or 0) for d, _ in docs]
    for k, (_, w) in zip(key, docs):
        for i in range(len(w) - window + 1):
            s = tuple(w[i:i + window])
            starts[s] = min(starts.get(s, k), k)
    out = []
    for k, (d, w) in zip(key, docs):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i:i + window])] < k:
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, None, "c", 1, "x") for d, t in rows], SCHEMA)
    return sorted(map(tuple, substrings.removed_words(docs, **options).collect()), key=str)


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["ä", "É,"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(11, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary)
                                                                     for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    return rows


@pytest.mark.parametrize("per_chunk", [2048, 5])
def test_equals_brute_force(spark, per_chunk):
    rows = made(120, 3) + [(7, None), (8, ""), (9, "  "), (None, made(120, 3)[5][1]), (None, "only here " * 20)]
    rows += [(200 + i, made(120, 3)[i][1]) for i in range(10)] + [(300, "the " * 5000), (301, "the " * 13)]
    rows += [(3, made(120, 3)[4][1])]
    assert run(spark, rows, docs_per_chunk=per_chunk) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_documents_without_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"a  {passage} b", None, "c", 1, "x"), (2, f"c {passage}  d", "s", "c", 1, "x"),
            (3, passage, "s", "c", 1, "x"), (4, None, "s", "c", 1, "x"), (None, " ", "s", None, 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = substrings.without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [rows[0], (2, "c d", "s", "c", 1, "x"), rows[3], rows[4]], key=str)
    counted = docs.withColumn("n_chars", F.length("text").cast("int"))
    got = {r.doc_id: r.n_chars for r in substrings.without_repeats(counted).collect()}
    assert got == {1: len(rows[0][1]), 2: 3, 4: None, None: 1}


def test_cover_has_an_aligned_anchor_for_any_two_positions():
    for i in range(7):
        for j in range(7):
            assert any((i + d) % 7 in substrings.COVER and (j + d) % 7 in substrings.COVER for d in range(7))


def test_bits_come_back_in_order(spark):
    rng = np.random.default_rng(2)
    keys = [np.unique(rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)) for _ in range(3)]
    keys[1] = np.unique(np.concatenate([keys[1], keys[0][::7]]))
    rows = [r for c, k in enumerate(keys) for r in ask.questions(c, 0, 11, k)]
    got = ask.answers(spark.createDataFrame(rows, ask.QUESTION)).filter(F.col("chunk") == 0).toArrow()
    assert (ask.bits_for(got, 0, keys[0], 11) == np.isin(keys[0], keys[1])).all()
