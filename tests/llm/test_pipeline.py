"""The pipeline against brute force on small documents of its own."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_substrings import brute as removed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = [f"w{i}" for i in range(4000)]
    passage = " ".join(rng.sample(word, 30))
    docs, labels = [], []
    for i in range(260):
        text = [rng.choice(word) for _ in range(rng.randint(20, 120))]
        toxic = int(i % 6 == 0)
        if toxic:
            text[3] = text[9] = text[15] = "idiot"
        if i % 9 == 1:
            text[5:5] = passage.split()
        docs.append((i, " ".join(text), "en", rng.choice("abc"), 0))
        labels.append((i, 1, toxic))
    docs += [(300 + k, docs[k][1] + " tail", "en", "a", 0) for k in range(1, 30)]
    docs += [(400, None, "en", "a", None), (401, "", None, None, 0), (None, "no id " * 3, "en", "b", 6)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_follow_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    kept = corpus_pipeline.toxic(spark, docs, folder)
    assert kept.columns == names
    rows = [tuple(r) for r in kept.collect()]
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in docs.collect() if "idiot" not in (r.text or ""))

    kept = corpus_pipeline.near_duplicate(spark, spark.createDataFrame(rows, DOCS), folder)
    first = {(d, c) for d, _, c in groups([(r[0], r[1]) for r in rows])}
    want = [r for r in rows if r[0] is None or (r[0], r[0]) in first]
    rows = [tuple(r) for r in kept.collect()]
    assert kept.columns == names and sorted(map(str, rows)) == sorted(map(str, want)) and len(rows) < 250

    kept = corpus_pipeline.repeated_passage(spark, spark.createDataFrame(rows, DOCS), folder)
    gone = {d: (n, k) for d, n, k, _ in removed([(r[0], r[1]) for r in rows])}
    before, rows = {r[0]: r for r in rows}, [tuple(r) for r in kept.collect()]
    assert kept.columns == names and len(rows) == len(before) and any(k for _, k in gone.values())
    for r in rows:
        n, k = gone[r[0]]
        assert len((r[1] or "").split()) == n - k and (k or r == before[r[0]])

    mixed = corpus_pipeline.mix(spark, spark.createDataFrame(rows, DOCS), folder)
    assert mixed.columns == names and set(map(str, map(tuple, mixed.collect()))) <= set(map(str, rows))
    packed = corpus_pipeline.pack(spark, mixed, folder).collect()
    assert sum(r.piece == 0 for r in packed) == mixed.count()


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(corpus_pipeline.run(spark, folder).select(columns).collect()) == key(docs.select(columns).collect())
