"""Keyed tables keep their layout; landed files are read by name and by primary document."""

import re

import pytest

from tallyforge.sources import feeds, landing, tables

ROWS = "ticker string, v int"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, ROWS)


def content(spark, path):
    return sorted((r.ticker, r.v) for r in tables.read_table(spark, path).collect())


def test_replace_uses_the_stored_number_of_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    every = [(f"T{i}", i) for i in range(50)]
    tables.write_table(rows(spark, every), path, key="ticker", buckets=8)
    new = rows(spark, [("T3", 100), ("T7", 200)])
    tables.replace_by_key(new, new.select("ticker"), path)
    assert content(spark, path) == sorted([x for x in every if x[0] not in ("T3", "T7")] + [("T3", 100), ("T7", 200)])
    for wrong in ({"buckets": 16}, {"key": "v"}):
        with pytest.raises(ValueError):
            tables.replace_by_key(new, new, path, **wrong)
    assert len(content(spark, path)) == 50


def test_replace_refuses_a_table_without_key(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(rows(spark, [("A", 1), ("B", 2)]), path)
    new = rows(spark, [("A", 9)])
    with pytest.raises(ValueError):
        tables.replace_by_key(new, new.select("ticker"), path)
    assert content(spark, path) == [("A", 1), ("B", 2)]


def test_interrupted_publish_goes_on(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    every = [(f"T{i}", i) for i in range(30)]
    tables.write_table(rows(spark, every), path, key="ticker", buckets=4)
    new = rows(spark, [(f"T{i}", 1000) for i in range(20)])
    moved = []
    drop = tables.drop_path

    def fail_later(spark_, folder):
        if "/bucket=" in folder:
            moved.append(folder)
            if len(moved) == 3:
                raise OSError("lost")
        drop(spark_, folder)

    monkeypatch.setattr(tables, "drop_path", fail_later)
    with pytest.raises(OSError):
        tables.replace_by_key(new, new.select("ticker"), path, run_id="again")
    monkeypatch.setattr(tables, "drop_path", drop)
    tables.replace_by_key(new, new.select("ticker"), path, run_id="again")
    assert content(spark, path) == sorted(every[20:] + [(f"T{i}", 1000) for i in range(20)])


def test_prices_by_the_header_of_each_file(spark, tmp_path):
    (tmp_path / "aaa.csv").write_text("Date,Open,Close\n2024-01-02,1,2\n")
    (tmp_path / "bbb.csv").write_text("Close,Date,Open\r\n3,2024-01-03,4\r\nbad\r\n")
    (tmp_path / "ccc.csv").write_text("Date,Open\n2024-01-02,1\n")
    got = {(r.ticker, str(r.date), r.close) for r in feeds.read_prices(spark, str(tmp_path), "s").collect()}
    assert got == {("AAA", "2024-01-02", 2.0), ("BBB", "2024-01-03", 3.0)}


def test_exhibits_are_not_filings(spark, tmp_path):
    folder = tmp_path / "320193" / "000032019325000001"
    folder.mkdir(parents=True)
    (folder / "main.htm").write_text("<p>main</p>")
    (folder / "ex21.htm").write_text("<p>exhibit</p>")
    from tallyforge.operators.documents import filing_documents
    newest = spark.createDataFrame([("T", 320193, "0000320193-25-000001", "main.htm")],
                                   "ticker string, cik bigint, accession_number string, primary_document string")
    got = filing_documents(newest, landing.read_filing_documents(spark, f"{tmp_path}/*/*")).collect()
    assert [r.html for r in got] == ["<p>main</p>"]


def test_roster_names_resolve_every_entity(spark):
    feed = "".join(f"<entry><title>{t}</title><id>CIK=0000001234</id></entry>" for t in (
        "McDonald&apos;s", "McDonald&#x27;s", "Caf&eacute; &amp; Co (0000001234)"))
    df = spark.createDataFrame([("k", 0, f"<feed>{feed}</feed>")], "k string, doc int, xml string")
    got = {r.company for r in feeds.roster_entries(df, "xml", ("k",)).collect()}
    assert got == {"McDonald's", "Café & Co"}


def test_colocated_tables_need_no_exchange(spark, tmp_path):
    from conftest import facts_df, planted_facts
    from tallyforge.operators.facts import ANNUAL
    from tallyforge.operators.flags import red_flags
    from tallyforge.operators.ratios import with_ratios
    from tallyforge.operators.statements import build_statements, to_wide
    from tallyforge.schemas import FACTS, STATEMENTS

    facts = facts_df(spark, planted_facts())
    tables.write_colocated(facts, str(tmp_path / "facts"), buckets=3)
    stored = tables.read_colocated(spark, str(tmp_path / "facts"), FACTS)
    tidy = build_statements(stored, [ANNUAL], by_ticker=True)
    assert "Exchange hashpartitioning" not in tidy._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, tidy.collect())) == sorted(map(str, build_statements(facts, [ANNUAL]).collect()))
    tables.write_colocated(tidy, str(tmp_path / "statements"), buckets=3)
    flags = red_flags(with_ratios(to_wide(tables.read_colocated(spark, str(tmp_path / "statements"), STATEMENTS))))
    assert "Exchange" not in flags._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, flags.collect())) == sorted(map(str, red_flags(with_ratios(to_wide(tidy))).collect()))


def test_rows_of_some_keys_read_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(rows(spark, [(f"T{i}", i) for i in range(40)]), path, key="ticker", buckets=8)
    some = tables.rows_of(spark, path, rows(spark, [("T3", 0), ("T4", 0), ("T3", 1), ("none", 0)]), ROWS)
    assert sorted((r.ticker, r.v) for r in some.collect()) == [("T3", 3), ("T4", 4)]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", some._jdf.queryExecution().executedPlan().toString())
    assert tables.rows_of(spark, str(tmp_path / "absent"), rows(spark, [("T3", 0)]), ROWS).count() == 0
