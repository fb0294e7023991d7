import datetime
import json
import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import documents, prices, registry
from tallyforge.plans import medallion, serving
from tallyforge.session import checkpoint_root
from tallyforge.sources import feeds, landing, tables
from tallyforge.streaming.ingest import apply_batch, ingest_available, landed_files
from tests.conftest import MILLION, planted_facts

ROWS = "ticker string, v int"


def content(spark, path):
    return sorted((r.ticker, r.v) for r in tables.read_table(spark, path).collect())


def put(spark, path, rows, keys, **kw):
    tables.replace_by_key(spark.createDataFrame(rows, ROWS),
                          spark.createDataFrame([(k,) for k in keys], "ticker string"), path, buckets=4, **kw)


def test_replace_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [("A", 1), ("B", 1), ("B", 2)], "AB")
    assert content(spark, path) == [("A", 1), ("B", 1), ("B", 2)]
    for _ in range(2):  # a replay changes nothing
        put(spark, path, [("B", 9), ("C", 3), ("X", 5)], "BC")
        assert content(spark, path) == [("A", 1), ("B", 9), ("C", 3)]
    put(spark, path, [], "AB")  # keys without rows disappear, with their bucket if it is empty
    assert content(spark, path) == [("C", 3)]
    put(spark, path, [("A", 7)], "")  # no keys: nothing happens
    assert content(spark, path) == [("C", 3)]


def test_first_run_without_rows_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [], "A")
    assert tables.read_table(spark, path, ROWS).count() == 0
    put(spark, path, [("A", 1), ("B", 1)], "AB")
    wider = spark.createDataFrame([("B", 2, "x")], ROWS + ", note string")
    tables.replace_by_key(wider, wider.select("ticker"), path, buckets=4)
    got = {(r.ticker, r.v, r.note) for r in tables.read_table(spark, path).collect()}
    assert got == {("A", 1, None), ("B", 2, "x")}
    put(spark, path, [("A", 3)], "A")  # old columns stay
    assert "note" in tables.read_table(spark, path).columns


def test_filing_without_landed_document(spark):
    newest = spark.createDataFrame([("T", 1, "10-K", "a", "2025-01-01", 1), ("T", 1, "10-K", "b", "2024-01-01", 2)],
                                   "ticker string, cik int, form string, accession_number string, "
                                   "filing_date string, filing_rank int")
    docs = spark.createDataFrame([("b", "<p>none</p>"), ("c", "other")], "accession_number string, html string")
    results = documents.document_results(documents.filing_documents(newest, docs))
    rows = {r.accession_number: r for r in documents.mdna_of(results, newest).collect()}
    assert set(rows) == {"a", "b"} and not rows["a"].extraction_ok and rows["a"].char_count == 0
    assert documents.segments_of(results).count() == 0


def test_interrupted_publish_is_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put(spark, path, [("A", 1), ("B", 1)], "AB")
    with monkeypatch.context() as m:
        def fail(*_):
            raise IOError("lost")
        m.setattr(tables, "_publish", fail)
        with pytest.raises(IOError):
            put(spark, path, [("A", 2)], "A", run_id="run-7")
    put(spark, path, [("A", 2)], "A", run_id="run-7")
    assert content(spark, path) == [("A", 2), ("B", 1)]


def test_absent_table_is_empty_with_schema(spark, tmp_path):
    df = tables.read_table(spark, str(tmp_path / "none"), schemas.SEGMENTS, order_by=["ticker"])
    assert df.count() == 0 and df.columns[0] == "ticker"
    tables.write_table(df, str(tmp_path / "empty"))
    assert tables.read_table(spark, str(tmp_path / "empty")).columns == df.columns


def test_restore_types(spark):
    df = spark.createDataFrame([("1", "6199.0", "x", None), ("2.5", "7.0", "3", None)],
                               "a string, sic string, c string, d string")
    out = tables.restore_types(df, keep_text=("sic",))
    assert dict(out.dtypes) == {"a": "double", "sic": "string", "c": "string", "d": "string"}


def test_registry_and_validation(spark):
    doc = json.dumps({"0": {"cik_str": 7, "ticker": "acme", "title": "Acme"},
                      "1": {"cik_str": 8, "ticker": "ACME", "title": "Other"},
                      "2": {"cik_str": 9, "ticker": "ZED", "title": "Zed"}})
    entries = landing.registry(spark.createDataFrame([(doc,)], "value string"))
    asked = spark.createDataFrame([(" acme ",), ("nope",), ("b-d",), ("zed",)], "ticker string")
    found = registry.lookup_tickers(asked, entries)
    assert {r.ticker: r.title for r in found.collect()} == {"ACME": "Acme", "NOPE": None, "B-D": None, "ZED": "Zed"}
    assert registry.rejects(found).count() == 2
    have = spark.createDataFrame([("ZED",)], "ticker string")
    status = {r.ticker: r.status for r in registry.validate_tickers(asked, entries, have).collect()}
    assert status == {"ACME": "accepted", "NOPE": "unknown", "B-D": "invalid", "ZED": "already_available"}
    work = registry.work_list(found, have)
    report = registry.failure_report(work, have, asked.select(F.upper(F.trim("ticker")).alias("ticker")))
    with pytest.raises(RuntimeError, match="NOPE"):
        registry.fail_on_requested(report)
    assert registry.work_list(found, have, include_existing=False).count() == 4


def test_prices(spark, tmp_path):
    for source, n in (("first", 11), ("second", 30)):
        for ticker in ("aaa", "bbb"):
            rows = n if (source, ticker) != ("first", "bbb") else 10
            folder = tmp_path / source
            folder.mkdir(exist_ok=True)
            lines = [f"{datetime.date(2024, 1, 1) + datetime.timedelta(d)},1,{100 + d}" for d in range(rows)]
            (folder / f"{ticker}.csv").write_text("Date,Open,Close\n" + "\n".join(lines))
    quotes = feeds.read_prices(spark, str(tmp_path / "first"), "first") \
        .unionByName(feeds.read_prices(spark, str(tmp_path / "second"), "second"))
    chosen = prices.choose_source(quotes, "first", "second")
    assert {(r.ticker, r.source): r["count"] for r in chosen.groupBy("ticker", "source").count().collect()} == \
        {("AAA", "first"): 11, ("BBB", "second"): 30}
    shares = spark.createDataFrame([("AAA", "2024-01-01", 5.0, "2024-02-01", "a"),
                                    ("AAA", "2024-01-01", 6.0, "2024-02-01", "b")],
                                   "ticker string, period_end string, val double, filed string, accn string")
    card = {r.ticker: r for r in prices.price_card(chosen, prices.latest_shares(shares)).collect()}
    assert card["AAA"].last_close == 110 and card["AAA"].market_cap == 660
    assert card["AAA"].day_change == pytest.approx(110 / 109 - 1) and card["BBB"].market_cap is None
    assert prices.recent_prices(chosen, kept=3).count() == 6


def test_feeds(spark):
    atom = ("<feed><entry><title>A &amp; B (0001234567)</title><id>?CIK=0001234567</id></entry>"
            "<entry><title>C</title></entry><entry><title>C</title><id>CIK=0009</id></entry></feed>")
    df = spark.createDataFrame([("10", 1, atom)], "sic string, doc int, xml string")
    assert {(r.company, r.cik) for r in feeds.roster_entries(df, "xml", ("sic",)).collect()} == \
        {("A & B", 1234567), ("C", None)}


# ---- landed files, streaming, pipeline, serving ---------------------------------------

def company_json(rows):
    facts = {}
    for r in rows:
        tag = facts.setdefault(r["taxonomy"], {}).setdefault(r["tag"], {"label": r["label"], "units": {}})
        tag["units"].setdefault(r["unit"], []).append(
            {"start": r["period_start"], "end": r["period_end"], "val": r["val"], "fy": r["fy"], "fp": r["fp"],
             "form": r["form"], "filed": r["filed"], "accn": r["accn"]})
    return json.dumps({"cik": 1, "facts": facts})


def small(value, tag="Assets"):
    return json.dumps({"facts": {"us-gaap": {tag: {"label": "x", "units": {"USD": [
        {"end": "2024-12-31", "val": value, "fy": "bad", "form": "10-K", "filed": "2025-02-01", "accn": "a"},
        {"end": "2023-12-31", "val": "n/a"}, {"end": "2022-12-31", "val": "NaN"}]}}}}})


def test_flatten(spark):
    docs = spark.createDataFrame([("A", small(5)), ("B", "{broken"), ("C", '{"facts": {}}')],
                                 "ticker string, value string")
    rows = landing.flatten_facts(docs).orderBy("period_end").collect()
    assert [(r.ticker, r.val, r.fy) for r in rows] == [("A", None, None)] * 2 + [("A", 5.0, None)]
    assert landing.flatten_facts(docs).columns == [f.split()[0] for f in schemas.FACTS.split(", ")]


def test_stream_replaces_only_landed_companies(spark, tmp_path):
    land, table, cp = (str(tmp_path / n) for n in ("land", "facts", "cp"))
    os.makedirs(land)
    write = lambda name, doc: open(f"{land}/{name}", "w").write(doc)
    state = lambda: {(r.ticker, r.val) for r in tables.read_table(spark, table).filter("val is not null").collect()}
    run = lambda c=cp: ingest_available(landed_files(spark, land), table, c, buckets=4)
    write("aaa.json", small(1)), write("bbb.json", small(1))
    run()
    assert state() == {("AAA", 1.0), ("BBB", 1.0)}
    time.sleep(1.1)
    write("Aaa.v2.json".replace(".v2", ""), small(2)), write("bbb2.json", "{broken")
    run()
    assert state() == {("AAA", 2.0), ("BBB", 1.0)}
    run()
    run(str(tmp_path / "cp2"))  # a replay of everything from a new checkpoint
    assert state() == {("AAA", 2.0), ("BBB", 1.0)}


def test_newest_document_of_a_batch_wins(spark, tmp_path):
    docs = spark.createDataFrame([("A", small(1), "f1", 1), ("A", small(2), "f2", 2), ("B", small(3), "f1", 1)],
                                 "ticker string, value string, file_path string, file_time int")
    apply_batch(docs, str(tmp_path / "t"), buckets=4)
    rows = tables.read_table(spark, str(tmp_path / "t")).filter("val is not null").collect()
    assert {(r.ticker, r.val) for r in rows} == {("A", 2.0), ("B", 3.0)}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    land = root / "landing"
    files = {
        "registry/company_tickers.json": json.dumps({"0": {"cik_str": 42, "ticker": "TEST", "title": "TEST CORP /DE/"}}),
        "facts/test.json": company_json(planted_facts()),
        "submissions/TEST.json": json.dumps({
            "sic": 3571, "sicDescription": "Computers", "website": "", "fiscalYearEnd": "0930",
            "exchanges": ["Nasdaq", "X"], "addresses": {"business": {"city": "Town", "zipCode": "01234"}},
            "filings": {"recent": {"form": ["10-K", "10-K", "10-K", "S-1"],
                                   "accessionNumber": ["0000000042-26-000001", "0000000042-25-000001",
                                                       "0000000042-24-000001", "x"],
                                   "filingDate": ["2026-02-15", "2025-02-15", "2024-02-15", "2024-01-01"],
                                   "reportDate": ["2025-12-31", "", "2023-12-31", ""],
                                   "primaryDocument": ["a.htm", "b.htm", "c.htm", "d.htm"]}}}),
        "documents/42/000000004226000001/a.htm":
            "<p>Item 7. Management's Discussion</p>" + "<p>Receivables collection slowed for customers.</p>" * 90
            + "<p>Item 8. Financial Statements</p>"
            + '<xbrli:context id="c"><xbrldi:explicitMember dimension="srt:ProductOrServiceAxis">x:PhoneMember'
              "</xbrldi:explicitMember><xbrli:startDate>2025-01-01</xbrli:startDate><xbrli:endDate>2025-12-31"
              '</xbrli:endDate></xbrli:context><ix:nonFraction name="us-gaap:Revenues" contextRef="c" scale="6">'
              "700</ix:nonFraction>",
        "documents/42/000000004225000001/b.htm": "<p>No section here</p>",
    }
    for name, body in files.items():
        path = land / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    where = medallion.Store(str(root / "lake"))
    landed = medallion.ingest(spark, where, str(land), "2026-03-01 00:00:00", buckets=4)
    assert [r.ticker for r in landed.collect()] == ["TEST"]
    medallion.build_silver(spark, where)
    medallion.build_gold(spark, where)
    return where


def test_pipeline_tables(spark, store):
    table = lambda layer, name, ddl=None: tables.read_table(spark, store.path(layer, name), ddl)
    company = table("bronze", "companies").first()
    assert (company.cik, company.entity_name, company.n_fact_rows) == (42, "TEST CORP /DE/", 37)
    profile = table("bronze", "company_profile").first()
    assert (profile.sic, profile.website, profile.hq_city, profile.hq_zip, profile.exchange, profile.hq_street) == \
        ("3571", None, "Town", "01234", "Nasdaq", None)
    assert {str(r.report_date) for r in table("bronze", "filings").collect()} == {"2025-12-31", "None", "2023-12-31"}
    mdna = {r.accession_number: r for r in table("bronze", "mdna").collect()}
    assert mdna["0000000042-26-000001"].extraction_ok and not mdna["0000000042-25-000001"].extraction_ok
    assert len(mdna) == 2
    segment = table("bronze", "segment_revenue").first()
    assert (segment.label, segment.value, segment.ticker) == ("Phone", 700 * MILLION, "TEST")
    assert medallion.statements(spark, store).count() == 36
    assert medallion.statements(spark, store, "10-Q").count() == 0
    assert table("silver", "statements_wide").count() == 3 and table("silver", "statements_wide_q", schemas.WIDE).count() == 0
    assert table("silver", "mdna_chunks").count() >= 2
    flags = {(str(r.period_end), r.rule_id) for r in table("gold", "anomalies").collect()}
    assert ("2025-12-31", "ar_outpaces_revenue") in flags
    counts = tables.row_counts({n: table("bronze", n) for n in ("companies", "filings")})
    assert {r.table_name: r.n_rows for r in counts.collect()} == {"companies": 1, "filings": 3}


def test_serving_functions(spark, store):
    table = lambda layer, name: tables.read_table(spark, store.path(layer, name))
    serving.register_functions(spark, table("bronze", "companies"), medallion.statements(spark, store),
                               table("gold", "ratios"), table("gold", "anomalies"), table("silver", "mdna_chunks"))
    call = lambda name, **args: json.loads(serving.call(spark, name, args).first().result)
    assert call("list_companies") == [{"ticker": "TEST", "cik": 42, "entity_name": "TEST CORP /DE/"}]
    income = call("get_statements", p_ticker="test", p_statement="is")
    assert {i["line_item"] for i in income} == {"revenue", "cost_of_revenue", "operating_income", "net_income"}
    assert call("get_ratios", p_ticker="TEST")[-1]["current_ratio"] == pytest.approx(1.6)
    flags = call("get_anomalies", p_ticker="TEST")
    metrics = json.loads([f for f in flags if f["rule_id"] == "ar_outpaces_revenue"][-1]["metrics"])
    assert metrics["revenue_growth"] == 0.1 and metrics["accounts_receivable_growth"] == 0.5
    found = call("search_mdna", p_ticker="test", p_query="Receivables collection zebra")
    assert found[0]["score"] == 2 and len(found[0]["excerpt"]) == 1200
    assert call("search_mdna", p_ticker="TEST", p_query="zebra") == []
    assert call("get_ratios", p_ticker="a'; DROP TABLE x;--") == []
    with pytest.raises(KeyError):
        serving.call(spark, "drop_everything")
    requests = spark.createDataFrame(
        [(1, "list_companies", None, None), (2, "get_statements", "test", "is"), (3, "drop_everything", "TEST", ""),
         (4, "get_ratios", "none", None), (5, "get_anomalies", "TEST", None), (6, None, "TEST", None)],
        "request_id int, name string, p_ticker string, p_statement string")
    done = {r.request_id: r for r in serving.call_requests(spark, requests).collect()}
    assert json.loads(done[1].result) == call("list_companies")
    by_item = lambda rows: sorted(rows, key=lambda r: (r["line_item"], r["period_end"]))
    assert by_item(json.loads(done[2].result)) == by_item(income) and done[2].n_rows == len(income)
    assert json.loads(done[3].result) == {"error": "Unknown function: drop_everything"} and done[3].status == "error"
    assert (done[4].status, done[4].n_rows, done[4].result) == ("ok", 0, "[]")
    assert done[5].n_rows == len(flags) and done[6].status == "error"
    asked = spark.createDataFrame([(1, "test", "Receivables collection zebra")],
                                  "request_id int, ticker string, query string")
    batch = documents.search_passages(asked, table("silver", "mdna_chunks")).orderBy("rank").collect()
    assert [(r.score, r.excerpt) for r in batch] == [(f["score"], f["excerpt"]) for f in found]


@pytest.mark.parametrize("master, configured, root", [
    ("spark://host:7077", "/mnt/shared/", "/mnt/shared"),
    ("k8s://host", "file:///mnt/shared", "file:///mnt/shared"),
    ("spark://host:7077", None, "file:/mnt/warehouse/_shared"),
    ("local-cluster[2,1,1024]", None, "file:/mnt/warehouse/_shared")])
def test_checkpoint_root_of_a_cluster(master, configured, root):
    """A path without a scheme may be a mounted folder; without a setting the warehouse is what a cluster shares."""
    conf = {"spark.checkpoint.dir": configured, "spark.sql.warehouse.dir": "file:/mnt/warehouse"}
    hadoop = SimpleNamespace(get=lambda key, default: default)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(hadoopConfiguration=lambda: hadoop))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: conf[key]))
    assert checkpoint_root(session) == root
