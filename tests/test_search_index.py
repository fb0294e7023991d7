"""The index finds what a search through all chunks finds, and reads less."""

import datetime
import random
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import documents, search_index
from tallyforge.operators.search_index import SearchIndex, search

CHUNK = "ticker string, form string, filing_date date, accession_number string, chunk_id int, chunk_text string"
WORDS = ["cash", "flow", "flows", "a", "of", "Ärger", "日本語", "x\ny", "revenue", "rev", "ca", "segment", "ovf"]


def made(n, seed, tickers=("AA", "bb", "CC")):
    rng = random.Random(seed)
    return [(rng.choice(tickers), "10-K", None if i % 17 == 0 else datetime.date(2020, 1, 1 + rng.randint(0, 5)),
             f"acc{seed}-{i // 4}", i % 4, None if i % 29 == 0 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9))))
            for i in range(n)]


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id int, ticker string, query string")


ASKED = [(1, "aa", "cash flow a"), (2, "BB", "CASH cash  of ca"), (3, "cc", "nothing here"), (4, "zz", "cash"),
         (5, "AA", None), (6, "AA", ""), (7, "cc", "日本 x\ny é"), (8, "bb", "revenue segment ovf low ä"), (9, None, "cash")]


def both(spark, chunks, index, top=6):
    found, cost = search(requests(spark, ASKED), index, top)
    want = documents.search_passages(requests(spark, ASKED), chunks, top)
    names = want.columns
    return (sorted(map(tuple, found.select(names).collect())), sorted(map(tuple, want.collect())),
            {r.request_id: r for r in cost.collect()})


@pytest.mark.parametrize("n, top", [(300, 6), (40, 2), (3, 6)])
def test_equals_the_full_search(spark, tmp_path, n, top):
    chunks = spark.createDataFrame(made(n, n), CHUNK)
    index = SearchIndex(str(tmp_path))
    index.build(chunks, buckets=3)
    got, want, cost = both(spark, chunks, index, top)
    assert got == want and (want or n == 3)
    assert not {3, 4, 5, 6, 9} & set(cost)
    assert all(r.verified <= r.candidates <= r.posted for r in cost.values())


def test_texts_read_do_not_grow_with_the_chunks(spark, tmp_path):
    rare = [("AA", "10-K", datetime.date(2021, 1, 1), f"r-{i}", 0, "the rare zebra") for i in range(5)]
    many = [("AA", "10-K", datetime.date(2020, 1, 1), f"m-{i}", 0, f"the common text {i}") for i in range(2000)]
    chunks = spark.createDataFrame(rare + many, CHUNK)
    index = SearchIndex(str(tmp_path))
    index.build(chunks, buckets=2)
    found, cost = search(requests(spark, [(1, "AA", "zebra"), (2, "AA", "rare the common")]), index)
    by_request = {r.request_id: r for r in cost.collect()}
    assert (by_request[1].posted, by_request[1].verified) == (5, 5) and by_request[2].verified < 100
    assert found.filter("request_id = 1").count() == 5


def test_refresh_replaces_tickers(spark, tmp_path):
    first, second = made(120, 1), made(90, 2, ("bb", "DD"))
    index = SearchIndex(str(tmp_path))
    index.build(spark.createDataFrame(first, CHUNK), buckets=4)
    tickers = spark.createDataFrame([("BB",), ("dd",), ("CC",)], "ticker string")
    index.refresh(spark.createDataFrame(second, CHUNK), tickers)
    now = spark.createDataFrame([r for r in first if r[0] == "AA"] + second, CHUNK)
    got, want, _ = both(spark, now, index)
    assert got == want
    assert index.counts(spark).filter("ticker = 'CC'").count() == 0


def test_grams(spark):
    row = spark.createDataFrame([("abab", None, "é")], "a string, b string, c string").select(
        *[search_index.grams(F.col(c)).alias(f"g_{c}") for c in "abc"], search_index.word_grams(F.col("a")).alias("w"),
        search_index.word_grams(F.lit("xy")).alias("s")).first()
    assert sorted(row.g_a) == ["a", "ab", "aba", "b", "ba", "bab"] and row.g_b == [] and row.g_c == ["é"]
    assert sorted(row.w) == ["aba", "bab"] and row.s == ["xy"]


def posted(spark, index):
    """(ticker, gram, accession, chunk) of every list entry, and the number of rows."""
    rows = index.postings(spark).collect()
    names = {(r.ticker, r.block): list(zip(r.accession_numbers, r.chunk_ids)) for r in rows if r.gram is None}
    found = []
    for r in rows:
        if r.gram is not None:
            places, of = search_index.listed([bytes(r.places)])
            assert len(places) == r.n_chunks and not of.any()
            found += [(r.ticker, r.gram, *names[r.ticker, r.block][i]) for i in places.tolist()]
    return sorted(found), len(rows)


def keyed(rows):
    return sorted((t.upper(), g, a, c) for t, _, _, a, c, text in rows if text
                  for g in {text.lower()[i:i + k] for k in (1, 2, 3) for i in range(len(text.lower()) - k + 1)})


def odd(n):
    rows = [(t, "10-K", None, a, c, text and f"{text} \U0001f600{i % 7}") for i, (t, _, _, a, c, text) in enumerate(made(n, 3))]
    return rows + rows[:5]


def test_lists_are_packed_per_block(spark, tmp_path):
    """One row per gram and block; every chunk of every gram is in its list."""
    index = SearchIndex(str(tmp_path))
    index.build(spark.createDataFrame(odd(200), CHUNK), buckets=2)
    got, n_rows = posted(spark, index)
    want = keyed(odd(200))
    assert got == want and n_rows < len(got) / 3
    counts = {(r.ticker, r.gram): r.n_chunks for r in index.counts(spark).collect()}
    assert sum(counts.values()) == len(want) and len(counts) == len({w[:2] for w in want})


@pytest.mark.parametrize("limit, value", [("BLOCK_CHARS", 200), ("KEYS", 20000)])
def test_blocks_are_bounded(monkeypatch, limit, value):
    monkeypatch.setattr(search_index, limit, value)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: mock.Mock(partitionId=lambda: 3))
    batch = pa.RecordBatch.from_pylist([
        {"ticker": t.upper(), "accession_number": a, "chunk_id": c, "text": text and text.lower()} for t, _, _, a, c, text in odd(60)])
    rows = [r for found in search_index._posted(iter([batch])) for r in found.to_pylist()]
    names = {r["block"]: list(zip(r["accession_numbers"], r["chunk_ids"])) for r in rows if r["gram"] is None}
    assert len(names) > 6 and {block >> 32 for block in names} == {3}
    assert keyed(odd(60)) == sorted((r["ticker"], r["gram"], *names[r["block"]][i]) for r in rows if r["gram"] is not None
                                    for i in search_index.listed([r["places"]])[0].tolist())


def test_long_steps_between_places():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(1 << 23, n, replace=False)) for n in (1, 2, 5, 300)] + [np.arange(400), np.array([0])]
    packed = [search_index._packed(np.diff(x, prepend=-1) - 1)[0].tobytes() for x in lists]
    place, of = search_index.listed(packed)
    assert (place == np.concatenate(lists)).all()
    assert of.tolist() == [i for i, x in enumerate(lists) for _ in x] and len(packed[4]) == 400


def test_texts_of_other_chunks_stay(spark):
    """Few of the chunks that are not wanted pass the bits, all wanted ones do."""
    chunks = spark.range(3000).selectExpr("'AA' AS ticker", "cast(id AS string) AS accession_number", "0 AS chunk_id")
    wanted = chunks.filter("cast(accession_number AS int) % 30 = 0")
    near = search_index._near(chunks, wanted)
    assert near.columns == chunks.columns and near.join(wanted, chunks.columns).count() == 100
    assert near.count() < 600
    assert search_index._near(chunks, wanted.limit(0)).count() == 0


def test_a_text_of_null_holds_no_word(spark):
    chunks = spark.createDataFrame([("AA", "10-K", None, "a", 0, None), ("AA", "10-K", None, "b", 0, "cash")], CHUNK)
    found = documents.search_passages(requests(spark, [(1, "AA", "cash")]), chunks)
    assert [r.accession_number for r in found.collect()] == ["b"]
