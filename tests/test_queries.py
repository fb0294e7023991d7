"""Registered queries against the other engine, and the shape of their plans."""

import os
import re
import tempfile

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers the queries
from driver.registry import ORACLE, QUERIES
from tallyforge.functions.text import with_text
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
WRITERS = {"upsert_replace", "stream_ingest"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


# A tiny company set leaves these without rows; they are compared on the next larger one.
NEED_MORE = {"income_segment_edges", "income_flow_edges", "income_flow_latest"}
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    more = name in NEED_MORE
    assert compare(spark, connect(LARGER) if more else con, name, LARGER if more else SF) == ""


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["statements_annual", "statements_wide", "red_flags", "flag_heatmap",
                                  "kpi_row", "common_size_annual", "trend_series", "income_flow_edges"])
def test_statement_plans(spark, name):
    """One scan, two shuffles, no Python, and copies cut before the first shuffle."""
    text = plan(spark, name)
    assert text.count("FileScan") == 1
    assert len(re.findall("Exchange hashpartitioning", text)) == 2
    assert "Python" not in text and "ArrowEval" not in text and "SinglePartition" not in text
    assert re.search(r"Exchange hashpartitioning\(ticker.*\n.*WindowGroupLimit", text)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_cross_products(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_reach_the_scan(spark, tmp_path):
    from driver import fixtures as fx
    from tallyforge.operators.facts import ANNUAL
    from tallyforge.operators.statements import build_statements
    fx.facts(spark, SF).write.parquet(str(tmp_path / "facts"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = build_statements(spark.read.parquet(str(tmp_path / "facts")), [ANNUAL])
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(taxonomy,us-gaap)" in text and "EqualTo(form,10-K)" in text
    read = re.search("ReadSchema: struct<(.*?)>", text).group(1)
    assert "val:double" in read and "frame:" not in read and "label:" not in read


def test_recent_filings_of_companies_with_six_digits(spark, tmp_path):
    """Customers 123456 and 123457 share the ticker S12345; each has filings of its own."""
    rows = [(i, 123456 + i % 2, "F", f"2024-01-{i + 1:02d}") for i in range(8)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, day string")
    orders.selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "cast(day as timestamp) as o_orderdate") \
        .coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert compare(spark, con, "recent_filings", str(tmp_path)) == ""


@pytest.mark.parametrize("name", ["stream_ingest", "stream_ingest_late"])
def test_streams_of_orders_with_six_digits(spark, tmp_path, name):
    """Orders 123450 to 123459 share the ticker S12345; a landing replaces each one's own document only."""
    rows = [(123450 + i, "FOP"[i % 3], 100.0 + i) for i in range(10)] + [(7, "F", 1.0), (12345, "O", 2.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double") \
        .coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert compare(spark, con, name, str(tmp_path)) == ""


@pytest.mark.parametrize("name", ["filing_sections", "indexed_search", "indexed_search_cost", "refreshed_statements"])
def test_staged_queries_on_a_cluster_with_a_mounted_folder(spark, con, name, tmp_path, monkeypatch):
    """A cluster's folder may have no scheme; what a query keeps goes there and nowhere else."""
    monkeypatch.setattr(type(spark.sparkContext), "master", property(lambda self: "spark://host:7077"), raising=False)
    monkeypatch.setattr(tempfile, "mkdtemp", lambda **kinds: pytest.fail("a folder that executors do not share"))
    conf, got = type(spark.conf), type(spark.conf).get
    monkeypatch.setattr(conf, "get", lambda self, key, *default: str(tmp_path) if key == "spark.checkpoint.dir"
                        else got(self, key, *default))
    assert compare(spark, con, name, SF) == ""
    assert any(tmp_path.iterdir())


def test_html_to_text_with_a_cut_reference(spark, tmp_path):
    """A reference without its semicolon stays as it is, also beside one of the full entity table."""
    html = "<p>a &amp; b &amp</p><p>&lt;c&gt; &amp;lt; &ampx; &notit; &copy</p>"
    spark.createDataFrame([(1, html), (2, "x &amp"), (3, None)], "page_id long, html string") \
        .coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert compare(spark, con, "html_to_text", str(tmp_path)) == ""
    text = with_text(spark.sql("select '&eacute; &#233; &#xE9; &eacute &amp; &notit;' as html"), "html", ended_only=True)
    assert text.first().text == "é é é &eacute & &notit;"
