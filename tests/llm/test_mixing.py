import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string"


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def in_sql(rows):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    if rows:
        con.executemany("insert into documents values (?,?,?,?,?)", [r[:5] for r in rows])
    return sorted(con.execute("select doc_id, size, source_size, target, taken from (" + mixing.SQL + ")").fetchall(),
                  key=str)


def made(n):
    return [(i, " ".join(["w"] * (i * 7 % 23)) if i % 11 else None, "en",
             None if i % 5 == 0 else ["b", "a", "Z", "é"][i % 4], 0, "x") for i in range(n)]


@pytest.mark.parametrize("bucket", [4096, 7])
def test_equals_sql_and_meets_targets(spark, bucket):
    rows = made(300) + [(3, "same id other text", "en", "a", 0, "x")]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), docs_per_bucket=bucket)
    assert rows_of(got) == in_sql(rows)
    sums = got.groupBy("source", "source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) < 1 and r.target <= 2 * r.source_size for r in sums)
    assert got.filter("taken > 2 * size").count() == 0


def test_empty_table_and_texts_without_words(spark):
    assert rows_of(mixing.mix_sources(spark.createDataFrame([], SCHEMA))) == []
    rows = [(1, None, "en", "a", 0, "x"), (2, " \t", "en", None, 0, "x"), (None, "", "en", "a", 0, "x")]
    got = rows_of(mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)))
    assert got == in_sql(rows) and all(r[1] == r[4] == 0 for r in got)


def test_mixed_documents_repeat_whole_rows(spark):
    rows = made(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in mixing.mix_sources(docs).collect():
        assert counts.get(r.doc_id, 0) == (int(r.taken / r.size + 0.5) if r["size"] else 1)
