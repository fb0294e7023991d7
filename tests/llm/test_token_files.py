import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import packing
from tallyforge.llm import token_files as tf
from tallyforge.llm.tokens import UnitEncoder

SCHEMA = "doc_id long, text string, source string, part int, packed string, n_ids string"


def ids_of(text):
    encode = UnitEncoder.get(tf.word_tokenizer()).tokenizer.encode
    return encode(text or "", add_special_tokens=False).ids + [2]


def rows_of(texts):
    return [(i, t, None, 1, "x", "y") for i, t in texts]


@pytest.mark.parametrize("per_range", [8192, 9])
def test_round_trip(spark, tmp_path, per_range):
    texts = [None, "", " \n", "Hello, WORLD! it's", "b" * 4000, "éa ñ  x\ty" * 300, "日本語 😀 <|endoftext|>"]
    rows = [(i * 3 % 101, f"{t or ''} {i}" if i > 6 else t) for i, t in enumerate(texts * 12)]
    rows += [(4, "again"), (4, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows_of(rows), SCHEMA).repartition(5)
    folder = str(tmp_path / "ids")
    tf.write_token_files(docs, folder, tf.word_tokenizer(), docs_per_range=per_range)
    got = sorted(tf.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        at += len(ids)
    want = sorted((str(d), ids_of(t)) for d, t in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    few = tf.read_token_files(spark, folder, doc_ids=[4, 9]).collect()
    assert sorted(r.doc_id for r in few) == sorted(d for d, _ in rows if d in (4, 9))


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "ids")
    tf.write_token_files(spark.createDataFrame([], SCHEMA), folder, tf.word_tokenizer())
    assert tf.read_token_files(spark, folder).collect() == []


def test_damaged_dictionary_is_refused(spark, tmp_path):
    folder = str(tmp_path / "ids")
    docs = spark.createDataFrame(rows_of([(i, f"some words {i} and more") for i in range(200)]), SCHEMA)
    tf.write_token_files(docs, folder, tf.word_tokenizer())
    dictionary = spark.read.parquet(f"{folder}/dictionary")
    dictionary.withColumn("dictionary", F.lit(b"other")).write.parquet(f"{folder}-2/dictionary")
    for part in ("shards", "index"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{folder}-2/{part}")
    with pytest.raises(ValueError):
        tf.read_token_files(spark, f"{folder}-2")


@pytest.mark.parametrize("path", [packing.byte_tokenizer, tf.word_tokenizer])
def test_ids_are_those_of_the_library_call(path):
    library = Tokenizer.from_file(path())
    held = [t.content for t in library.get_added_tokens_decoder().values()]
    texts = ["plain words", "one " + held[0] + " two", held[-1], "", None, "a" + held[0] + held[-1] + "b c", "x",
             "one " + held[0].upper() + " two  ", held[0][:-1], held[0][-1] + " y", "q " * 50 + held[0] + "\n\n" + held[0]]
    got = []
    for _, ids, count in UnitEncoder(path()).slices(pa.array(texts, pa.string())):
        got += [part.tolist() for part in np.split(ids, np.cumsum(count)[:-1])]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_dictionary_sample_does_not_depend_on_the_order_of_files(spark, monkeypatch):
    monkeypatch.setattr(tf, "SAMPLE_DOCS", 20)
    docs = spark.createDataFrame(rows_of([(i, f"text {i} of source {i // 100}") for i in range(300)]), SCHEMA)
    first = tf._sample_ids(docs, tf.word_tokenizer())
    assert len(first) == 20
    assert first == tf._sample_ids(docs.orderBy(F.desc("doc_id")), tf.word_tokenizer())
