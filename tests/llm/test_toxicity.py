import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import toxicity as tox

DOCS = "doc_id long, text string, source string, score int, stem string, toxic int"
LABELS = "doc_id long, quality int, toxic int"


def label(text, **entries):
    acceptor = tox.Acceptor({w: s for s, t in tox.SEEDS.items() for w in t.split()} | entries)
    x = tox.features(pa.array([text], pa.string()), acceptor)[0, :16]
    return sorted(np.flatnonzero(x).tolist())


def test_composed_machine_tells_clauses_apart():
    plain, targeted, reported, negated = 0, 1, 2, 4
    assert label("what an idiot walked in") == [plain]
    assert label("you are an idiot") == [targeted]
    assert label("an article said idiot drivers") == [reported]
    assert label("that is not an idiot") == [negated]
    assert label("you. An idiot walked in") == [plain]
    assert label("you are not an idiot! \"IDIOTS\"") == [plain, targeted | negated]
    assert label("they will kill") == [8 | targeted]
    assert label("skill and trashing") == []
    assert label("") == label(None) == []


def test_all_marks_around_a_word_are_left_out():
    for text in ("....idiot", "<<<<moron", "trash!!!!", "¡idiot!", "«trash»", "(\"¿¡“trash”!!…»)", "¡¡¡¡¡trash"):
        assert label(text) == [0], text
    assert label("....") == label("¡¡¡") == label("»") == label("étrash") == []


def test_compose_is_the_product():
    step, emit = tox.MACHINE
    assert step.shape == emit.shape == (1 * 4 * 2 * 5, 7)
    assert step.max() < len(step) and emit.max() < tox.LABELS


def corpus(n):
    rng = np.random.default_rng(5)
    syllables = ["an", "re", "ti", "ou", "en", "sh", "er", "ha"]
    docs, labels = [], []
    for i in range(n):
        text = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(rng.integers(30, 200))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(4):
                text[rng.integers(len(text))] = "zorv" + "".join(rng.choice(syllables, 2)) + rng.choice(["", ",", "."])
        docs.append((i, " ".join(text), "s", 1, "x", 1 - toxic))
        if i % 2:
            labels.append((i, 1, toxic))
    return docs, labels


def test_learns_stems_from_rows_that_are_not_held_out(spark):
    docs, labels = corpus(1200)
    got = tox.score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    truth = {d[0]: 1 - d[5] for d in docs}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    right = np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out])
    assert right > 0.99
    flipped = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q, t) for i, q, t in labels]
    again = tox.score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(flipped, LABELS)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}


def test_hard_rows(spark):
    texts = [None, "", " ", "idiot " * 3000, "a" * 100_000, "fine words", "fine words"]
    docs = spark.createDataFrame([(i, t, None, 1, "x", 1) for i, t in enumerate(texts)] + [(None, "x", "s", 1, "", 1)],
                                 DOCS)
    labels = spark.createDataFrame([], LABELS)
    got = {r.doc_id: r.score for r in tox.score_toxicity(docs, labels).collect()}
    assert len(got) == 8 and got[0] == got[1] == got[5] and got[3] > 0.7 > got[0]
    assert tox.score_toxicity(docs.limit(0), labels).collect() == []
    assert tox.without_toxic(docs, labels).count() == 7


def test_driver_tables(spark):
    import os
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("driver tables absent")
    got = tox.op5_toxicity(spark, sf).filter("held_out")
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9


def test_only_equal_texts_fall_away_before_fitting(spark):
    keep = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    texts = {i: f"a common word and number{i} of the texts" for i in keep}
    texts[keep[1]] = texts[keep[0]].upper() + "  "
    docs = spark.createDataFrame([(i, t, "s", 1, "x", 1) for i, t in texts.items()], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in keep], LABELS)
    labels = labels.unionByName(spark.createDataFrame([(keep[1], 1, keep[0] % 2)], LABELS))
    same = keep[0] % 2 == keep[1] % 2 or keep[0] % 2 == 1
    got = sorted((r.text, r.toxic) for r in tox.training_rows(docs, labels).collect())
    assert len(got) == len(keep) - same
    again = tox.training_rows(docs.repartition(7), labels.repartition(3)).collect()
    assert sorted((r.text, r.toxic) for r in again) == got
    few = tox.training_rows(docs, labels, 20).collect()
    assert sum(r.toxic for r in few) == 20 and len(few) == 40
