"""Landed documents, stored tables, ingestion, serving and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driver import fixtures as fx
from driver.explore_queries import _ingested
from driver.oracle import FACTS, TO_FLAGS, TO_STATEMENTS
from driver.queries import annual_periods, annual_statements, annual_wide
from driver.registry import checked, iso
from tallyforge.functions import scalar
from tallyforge.operators.flags import red_flags as build_flags
from tallyforge.operators.ratios import compute_ratios, with_ratios
from tallyforge.operators.registry import first_registry_entry
from tallyforge.operators.statements import to_wide
from tallyforge.plans import medallion, serving
from tallyforge.schemas import CHUNKS, STATEMENTS
from tallyforge.session import checkpoint_root
from tallyforge.sources import feeds, landing, tables
from tallyforge.streaming.ingest import ingest_available

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def _scratch(spark) -> str:
    """A new folder, below the shared one, for a query that writes."""
    return f"{checkpoint_root(spark)}/run-{uuid.uuid4().hex}"


# ---- company documents ------------------------------------------------------------

def _obs(val, fy, form, accn):
    day = F.col("l_shipdate").cast("date")
    return F.struct(F.date_sub(day, 90).cast("string").alias("start"),
                    day.cast("string").alias("end"), val.alias("val"), fy.alias("fy"),
                    F.lit("FY").alias("fp"), F.lit(form).alias("form"),
                    F.date_add(day, 30).cast("string").alias("filed"), accn.alias("accn"))


def _fact_documents(spark, sf_dir):
    """A company-facts document per line item row: two taxonomies, two units."""
    accn = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
                       F.col("l_linenumber").cast("string"))
    price = F.col("l_extendedprice").cast("string")
    bad = F.when(F.col("l_discount") == 0, "n/a").otherwise(F.col("l_quantity").cast("string"))
    year = F.year("l_shipdate").cast("string")
    dollars = F.array(_obs(price, year, "10-K", accn), _obs(bad, F.lit("none"), "10-Q", accn))
    count = F.array(_obs(F.col("l_partkey").cast("string"), year, "10-K", accn))
    revenue = F.struct(F.lit("Net sales").alias("label"),
                       F.create_map(F.lit("USD"), dollars, F.lit("shares"), count).alias("units"))
    cover = F.struct(F.lit(None).cast("string").alias("label"),
                     F.create_map(F.lit("shares"), count).alias("units"))
    facts = F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), revenue),
                         F.lit("dei"), F.create_map(
                             F.lit("EntityCommonStockSharesOutstanding"), cover))
    return fx.texts(spark, sf_dir, "lineitem").select(
        fx.ticker_of(F.col("l_suppkey")).alias("ticker"), F.to_json(F.struct(facts.alias("facts"))).alias("value"))


_L = """l as (select 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as ticker, cast(l_shipdate as date) as d,
  l_orderkey || '-' || l_partkey || '-' || l_linenumber as accn, l_extendedprice as price,
  case when l_discount = 0 then null else l_quantity end as qty, cast(l_partkey as double) as pk,
  cast(year(l_shipdate) as double) as y from lineitem)"""


@checked(f"""with {_L} select ticker, taxonomy, tag, label, unit, cast(d - 90 as varchar) as period_start,
  cast(d as varchar) as period_end, val, fy, form, cast(d + 30 as varchar) as filed, accn from (
  select *, 'us-gaap' as taxonomy, 'Revenues' as tag, 'Net sales' as label, 'USD' as unit, price as val, y as fy, '10-K' as form from l
  union all select *, 'us-gaap', 'Revenues', 'Net sales', 'USD', qty, null, '10-Q' from l
  union all select *, 'us-gaap', 'Revenues', 'Net sales', 'shares', pk, y, '10-K' from l
  union all select *, 'dei', 'EntityCommonStockSharesOutstanding', null, 'shares', pk, y, '10-K' from l)""")
def facts_flatten(spark, sf_dir):
    rows = landing.flatten_facts(_fact_documents(spark, sf_dir))
    return iso(rows.drop("fp", "frame").withColumn("fy", F.col("fy").cast("double")))


@checked("""select event_id, 'k' as key, try_cast(json_extract_string(props, '$.k') as double) as number
from events where json_extract_string(props, '$.k') is not null""")
def event_props(spark, sf_dir):
    """Free-form JSON coerced to numbers, one row per key."""
    props = F.from_json("props", "map<string, string>")
    return (fx.table(spark, sf_dir, "events").select("event_id", F.explode(props).alias("key", "raw"))
            .select("event_id", "key", F.col("raw").try_cast("double").alias("number")))


def _registry_documents(spark, sf_dir):
    """A ticker list per supplier with a second entry for the same ticker."""
    key = F.col("s_suppkey").cast("string")
    ticker = fx.ticker_of(F.col("s_suppkey"))
    entry = F.create_map(
        F.lit("0"), F.struct(key.alias("cik_str"), F.lower(ticker).alias("ticker"),
                             F.col("s_name").alias("title")),
        F.lit("1"), F.struct(key.alias("cik_str"), ticker.alias("ticker"),
                             F.lit("Later entry").alias("title")))
    return fx.table(spark, sf_dir, "supplier").select(F.to_json(entry).alias("value"))


@checked("""select 'S' || lpad(cast(s_suppkey as varchar), 5, '0') as ticker, s_suppkey as cik, s_name as title
from supplier""")
def ticker_registry(spark, sf_dir):
    entries = landing.registry(_registry_documents(spark, sf_dir))
    return first_registry_entry(entries).select("ticker", "cik", "title")


@checked("""with c as (select 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as ticker, count(*) as n
  from lineitem group by 1)
select 'S' || lpad(cast(s_suppkey as varchar), 5, '0') as ticker, s_suppkey as cik, s_name as entity_name,
       coalesce(n, 0) as n_fact_rows
from supplier left join c on c.ticker = 'S' || lpad(cast(s_suppkey as varchar), 5, '0')""")
def company_dimension(spark, sf_dir):
    landed = fx.companies(spark, sf_dir).select(
        "ticker", F.lit("2026-01-01 00:00:00").cast("timestamp").alias("fetched_at"))
    entries = landing.registry(_registry_documents(spark, sf_dir))
    return landing.company_dimension(landed, entries, fx.facts(spark, sf_dir)).drop("fetched_at")


def _filing_submissions(spark, sf_dir):
    """A submissions document per order with parallel arrays of four filings."""
    day = F.col("o_orderdate").cast("date").cast("string")
    key = F.col("o_orderkey").cast("string")
    status = F.when(F.col("o_orderstatus") == "F", "").otherwise(day)
    recent = F.struct(
        F.array(F.lit("10-K"), F.lit("4"), F.lit("DEF 14A"), F.lit("10-K/A")).alias("form"),
        F.array(*[F.concat(key, F.lit(s)) for s in ("-1", "-2", "-3", "-4")]).alias("accessionNumber"),
        F.array(day, day, day, day).alias("filingDate"),
        F.array(day, F.lit(""), status, day).alias("reportDate"),
        F.array(*[F.concat(F.lit(f"d{i}-"), key, F.lit(".htm")) for i in range(4)]).alias("primaryDocument"))
    doc = F.struct(F.struct(recent.alias("recent")).alias("filings"))
    return fx.texts(spark, sf_dir, "orders").select(
        fx.ticker_of(F.col("o_custkey")).alias("ticker"), F.col("o_custkey").alias("cik"),
        F.to_json(doc).alias("value"))


@checked("""with o as (select 'S' || lpad(cast(o_custkey as varchar), 5, '0') as ticker, o_custkey as cik, o_orderkey as k,
  cast(cast(o_orderdate as date) as varchar) as d, o_orderstatus as s from orders)
select ticker, cik, '10-K' as form, k || '-1' as accession_number, d as filing_date, d as report_date,
       'd0-' || k || '.htm' as primary_document from o
union all
select ticker, cik, 'DEF 14A', k || '-3', d, case when s <> 'F' then d end, 'd2-' || k || '.htm' from o""")
def filing_index(spark, sf_dir):
    return iso(landing.filing_index(landing.parse_submissions(_filing_submissions(spark, sf_dir))))


def _profile_documents(spark, sf_dir):
    """A submissions document per customer, with absent and empty attributes."""
    key = F.col("c_custkey").cast("string")
    rich = F.col("c_acctbal") >= 0
    exchanges = F.when(rich, F.array(F.col("c_mktsegment"), F.lit("Other"))) \
        .otherwise(F.array().cast("array<string>"))
    address = F.struct(F.struct(
        F.concat(key, F.lit(" Main St")).alias("street1"), F.lit("Town").alias("city"),
        F.when(rich, "DE").alias("stateOrCountry"), F.lpad(key, 5, "0").alias("zipCode")).alias("business"))
    doc = F.struct(
        F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("sic"),
        F.col("c_mktsegment").alias("sicDescription"),
        F.when(rich, F.concat(F.lit("https://"), "c_name")).otherwise("").alias("website"),
        F.lit("0930").alias("fiscalYearEnd"), exchanges.alias("exchanges"),
        F.when(rich, address).alias("addresses"))
    return fx.table(spark, sf_dir, "customer").select(
        fx.ticker_of(F.col("c_custkey")).alias("ticker"), F.col("c_custkey").alias("cik"),
        F.col("c_name").alias("entity_name"), F.to_json(doc).alias("value"))


@checked("""select 'S' || lpad(cast(c_custkey as varchar), 5, '0') as ticker, c_custkey as cik, c_name as entity_name,
  lpad(cast(c_nationkey as varchar), 4, '0') as sic, c_mktsegment as sic_description,
  case when c_acctbal >= 0 then 'https://' || c_name end as website, null::varchar as state_of_incorporation,
  '0930' as fiscal_year_end, case when c_acctbal >= 0 then c_custkey || ' Main St' end as hq_street,
  case when c_acctbal >= 0 then 'Town' end as hq_city, case when c_acctbal >= 0 then 'DE' end as hq_state,
  case when c_acctbal >= 0 then lpad(cast(c_custkey as varchar), 5, '0') end as hq_zip, null::varchar as phone,
  case when c_acctbal >= 0 then c_mktsegment end as exchange from customer""")
def profile_project(spark, sf_dir):
    return landing.company_profile(landing.parse_submissions(_profile_documents(spark, sf_dir)))


# ---- feeds ----------------------------------------------------------------------------

@checked("""with s as (select *, n_name from supplier join nation on n_nationkey = s_nationkey)
select lpad(cast(s_nationkey as varchar), 4, '0') as sic, s_name || ' & Sons' as company, cast(s_suppkey as double) as cik from s
union all
select distinct lpad(cast(s_nationkey as varchar), 4, '0'), n_name || ' HOLDING', null::double from s""")
def feed_roster(spark, sf_dir):
    """Atom rosters, one per supplier; the holding company repeats in every feed of a nation."""
    rows = fx.table(spark, sf_dir, "supplier").join(
        fx.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    cik = F.lpad(F.col("s_suppkey").cast("string"), 10, "0")
    atom = F.concat(
        F.lit("<feed><entry>\n<title> "), F.col("s_name"), F.lit(" &amp; Sons ("), cik,
        F.lit(")</title><link href='?CIK="), cik, F.lit("'/></entry><entry><title>"),
        F.col("n_name"), F.lit(" HOLDING</title></entry><entry><link/></entry></feed>"))
    docs = rows.select(F.lpad(F.col("s_nationkey").cast("string"), 4, "0").alias("sic"),
                       F.col("s_suppkey").alias("doc"), atom.alias("xml"))
    roster = feeds.roster_entries(docs, "xml", ("sic",))
    return roster.withColumn("cik", F.col("cik").cast("double"))


@checked("""with o as (select o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') as d, o_orderpriority as p from orders)
select o_orderkey, cast(i as bigint) as pos, case i when 0 then 'First & ' || p when 1 then '<b>raw</b>' else '' end as title,
       case when i < 2 then 'http://x/' || o_orderkey else '' end as link,
       case when i = 0 then substr(d, 1, 16) else '' end as date
from o, range(3) r(i)""")
def feed_news(spark, sf_dir):
    """RSS feeds of four items, the first three kept."""
    key = F.col("o_orderkey").cast("string")
    rss = F.concat(
        F.lit("<rss><channel><title>Feed</title><item><title>First &amp; "), F.col("o_orderpriority"),
        F.lit("</title><link>http://x/"), key, F.lit("</link><pubDate>"),
        F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"),
        F.lit("</pubDate></item><item><title><![CDATA[<b>raw</b>]]></title><link>http://x/"), key,
        F.lit("</link></item><item><pubDate></pubDate></item><item><title>Fourth</title></item></channel></rss>"))
    docs = fx.texts(spark, sf_dir, "orders").select("o_orderkey", rss.alias("xml"))
    return feeds.news_items(docs, "xml", ("o_orderkey",))


# ---- stored tables ----------------------------------------------------------------------

@checked(" union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in DRIVER_TABLES))
def row_counts(spark, sf_dir):
    return tables.row_counts({t: fx.table(spark, sf_dir, t) for t in DRIVER_TABLES})


_EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "props"]


@checked(" union all ".join(
    f"select '{c}' as column_name, count({c}) as n_values, count(try_cast(cast({c} as varchar) as double)) as n_numeric, "
    f"count({c}) > 0 and count({c}) = count(try_cast(cast({c} as varchar) as double)) as is_numeric from events"
    for c in _EVENT_COLUMNS))
def column_types(spark, sf_dir):
    as_text = [F.col(c).cast("string").alias(c) for c in _EVENT_COLUMNS]
    return tables.column_types(fx.table(spark, sf_dir, "events").select(*as_text))


_IN_ASIA = """asia as (select 'S' || lpad(cast(s_suppkey as varchar), 5, '0') as ticker from supplier
  join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA')"""


@checked(f"""with {FACTS}, {_IN_ASIA}
select ticker, form, count(*) as n_rows, count(distinct accn) as n_accn, cast(min(period_end) as varchar) as first_end
from fx where case when ticker in (select ticker from asia) then form = '10-Q' else form = '10-K' end
group by ticker, form""")
def upsert_replace(spark, sf_dir):
    """Write all annual facts, then replace the companies of one region by quarterly facts."""
    folder = _scratch(spark)
    facts = fx.facts(spark, sf_dir)
    path = f"{folder}/xbrl_facts"
    tables.write_table(facts.filter(F.col("form") == "10-K"), path, "ticker", buckets=8)
    tables.replace_by_key(facts.filter(F.col("form") == "10-Q"), _ingested(spark, sf_dir), path, buckets=8)
    stored = tables.read_table(spark, path)
    return iso(stored.groupBy("ticker", "form").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("accn").alias("n_accn"),
        F.min("period_end").alias("first_end")))


def _landings(spark, sf_dir, versions):
    """Company documents of all orders (version 1) and of the finished ones (version 2), one batch per version."""
    folder = _scratch(spark)
    orders = fx.table(spark, sf_dir, "orders")

    def document(version: int):
        obs = F.array(F.struct((F.col("o_totalprice") * version).cast("string").alias("val"),
                               F.lit(str(version)).alias("fy")))
        tag = F.create_map(F.lit("Assets"), F.struct(F.create_map(F.lit("USD"), obs).alias("units")))
        facts = F.create_map(F.lit("us-gaap"), tag)
        return F.to_json(F.struct(facts.alias("facts")))

    def land(rows, version: int) -> None:
        rows.select(fx.whole_ticker_of(F.col("o_orderkey")).alias("ticker"), document(version).alias("value"),
                    F.lit(f"v{version}").alias("file_path"),
                    F.timestamp_seconds(F.lit(version)).alias("file_time")) \
            .write.mode("append").parquet(f"{folder}/landing")

    def ingest() -> None:
        stream = spark.readStream.schema(
            "ticker string, value string, file_path string, file_time timestamp") \
            .parquet(f"{folder}/landing")
        ingest_available(stream, f"{folder}/facts", f"{folder}/stream-checkpoint", buckets=8)

    for version in versions:
        land(orders if version == 1 else orders.filter(F.col("o_orderstatus") == "F"), version)
        ingest()
    # The SQL shows five digits of an order; orders are replaced by their whole key.
    return tables.read_table(spark, f"{folder}/facts").select(F.substring("ticker", 1, 6).alias("ticker"), "val", "fy")


@checked("""select 'S' || lpad(cast(o_orderkey as varchar), 5, '0') as ticker,
  o_totalprice * case when o_orderstatus = 'F' then 2 else 1 end as val,
  cast(case when o_orderstatus = 'F' then 2 else 1 end as bigint) as fy from orders""")
def stream_ingest(spark, sf_dir):
    """Documents land twice; the second landing replaces the companies it contains."""
    return _landings(spark, sf_dir, [1, 2])


@checked("""select 'S' || lpad(cast(o_orderkey as varchar), 5, '0') as ticker,
  o_totalprice * case when o_orderstatus = 'F' then 2 else 1 end as val,
  cast(case when o_orderstatus = 'F' then 2 else 1 end as bigint) as fy from orders""")
def stream_ingest_late(spark, sf_dir):
    """The newer documents land first; the older ones of the same companies come in a later batch."""
    return _landings(spark, sf_dir, [2, 1])


@checked(f"""{TO_STATEMENTS} select ticker, statement, line_item, cast(period_end as varchar) as period_end, value, tag_used
from stmts where form = '10-K'""")
def refreshed_statements(spark, sf_dir):
    """Companies of one region land with other amounts first; the refresh after their second landing rebuilds only them."""
    store = medallion.Store(_scratch(spark))
    facts, path = fx.facts(spark, sf_dir), store.path("bronze", "xbrl_facts")
    asia = tables.staged(_ingested(spark, sf_dir), f"asia-{uuid.uuid4().hex}")
    early = facts.join(asia.withColumn("early", F.lit(True)), "ticker", "left").withColumn(
        "val", F.when(F.col("early"), F.col("val") * 7 + 1).otherwise(F.col("val"))).drop("early")
    tables.write_table(early, path, "ticker", buckets=8)
    medallion.record_changes(facts.select("ticker"), path, "first")
    medallion.refresh(spark, store)
    tables.replace_by_key(facts, asia, path)
    medallion.record_changes(asia, path, "second")
    medallion.refresh(spark, store)
    return iso(medallion.statements(spark, store).select(
        "ticker", "statement", "line_item", "period_end", "value", "tag_used"))


@checked(f"""{TO_FLAGS} select ticker, cast(period_end as varchar) as period_end, rule_id, severity
from flags where form = '10-K'""")
def colocated_flags(spark, sf_dir):
    """Statements stored in buckets of companies; pivot, ratios and flags follow without an exchange."""
    path = f"{_scratch(spark)}/statements"
    tables.write_colocated(annual_statements(spark, sf_dir), path, buckets=8)
    wide = to_wide(tables.read_colocated(spark, path, STATEMENTS))
    return iso(build_flags(with_ratios(wide)).select("ticker", "period_end", "rule_id", "severity"))


# ---- serving ------------------------------------------------------------------------------

@checked(f"""{TO_STATEMENTS} select ticker, statement, line_item, cast(period_end as varchar) as period_end, value, tag_used
from stmts where form = '10-K'""")
def serve_statements(spark, sf_dir):
    """JSON per company and statement, read back."""
    served = serving.statements_json(annual_statements(spark, sf_dir))
    item = "array<struct<line_item: string, period_end: string, value: double, tag_used: string>>"
    return served.select("ticker", "statement", F.inline(F.from_json("result", item)))


@checked(f"""{TO_FLAGS} select ticker, cast(period_end as varchar) as period_end, rule_id, severity
from flags where form = '10-K'""")
def serve_anomalies(spark, sf_dir):
    served = serving.anomalies_json(build_flags(annual_periods(spark, sf_dir)))
    item = "array<struct<period_end: string, rule_id: string, severity: string>>"
    return served.select("ticker", F.inline(F.from_json("result", item)))


def _serve_ratios_sql() -> str:
    from driver.oracle import TO_RATIOS
    return (f"{TO_RATIOS} select ticker, cast(period_end as varchar) as period_end, roe, current_ratio "
            "from ratios where form = '10-K'")


@checked(_serve_ratios_sql())
def serve_ratios(spark, sf_dir):
    served = serving.ratios_json(compute_ratios(annual_wide(spark, sf_dir)))
    item = "array<struct<period_end: string, roe: double, current_ratio: double>>"
    return served.select("ticker", F.inline(F.from_json("result", item)))


def _served(spark, sf_dir):
    statements = annual_statements(spark, sf_dir)
    periods = annual_periods(spark, sf_dir)
    no_chunks = spark.createDataFrame([], CHUNKS)
    serving.register_functions(spark, fx.companies(spark, sf_dir), statements, compute_ratios(annual_wide(spark, sf_dir)),
                               build_flags(periods), no_chunks)


@checked("""select 'S' || lpad(cast(s_suppkey as varchar), 5, '0') as ticker, s_suppkey as cik, s_name as entity_name
from supplier""")
def list_companies(spark, sf_dir):
    """All companies, through the table function."""
    _served(spark, sf_dir)
    return spark.sql("SELECT ticker, cik, entity_name FROM company_rows()")


@checked(f"""{TO_FLAGS}, asked as (
  select c_custkey as request_id, c_custkey % 3 as kind, 'S' || lpad(cast(c_custkey as varchar), 5, '0') as ticker from customer),
said as (select ticker, count(*) as n from stmts where form = '10-K' and statement = 'IS' group by 1),
flagged as (select ticker, count(*) as n from flags where form = '10-K' group by 1)
select request_id, case kind when 0 then 'get_statements' when 1 then 'get_anomalies' else 'drop_everything' end as name,
       case when kind < 2 then 'ok' else 'error' end as status,
       case kind when 0 then coalesce(s.n, 0) when 1 then coalesce(f.n, 0) end as n_rows
from asked left join said s on s.ticker = asked.ticker left join flagged f on f.ticker = asked.ticker""")
def call_by_name(spark, sf_dir):
    """A call per customer: statements, flags, or a function that does not exist."""
    _served(spark, sf_dir)
    key = F.col("c_custkey")
    requests = fx.table(spark, sf_dir, "customer").select(
        key.alias("request_id"), F.when(key % 3 == 0, "get_statements").when(key % 3 == 1, "get_anomalies")
        .otherwise("drop_everything").alias("name"), F.lower(fx.ticker_of(key)).alias("p_ticker"),
        F.lit("is").alias("p_statement"))
    return serving.call_requests(spark, requests).drop("result")


# ---- labels ---------------------------------------------------------------------------------

_PCT = "case when {0} is null then '—' else format('{{:+.1f}}%', ({0}) * 100) end"
_B = """case when abs(v) >= 1e12 then format('${:,.1f}T', v / 1e12) when abs(v) >= 1e9 then format('${:,.1f}B', v / 1e9)
 when abs(v) >= 1e6 then format('${:,.1f}M', v / 1e6) when abs(v) >= 1e3 then format('${:,.1f}K', v / 1e3)
 else format('${:,.0f}', v) end"""


@checked(f"""with o as (select *, o_totalprice * power(10.0::double, o_orderkey % 8) * case when o_orderstatus = 'F' then -1 else 1 end as v,
  nullif(o_custkey, 0) as base from orders)
select o_orderkey, {_B} as money, 'FY' || year(o_orderdate) as fy,
       {_PCT.format('(o_totalprice - base * 100.0) / abs(base * 100.0)')} as change,
       lpad(cast(o_custkey as varchar), 10, '0') as cik,
       o_custkey || '/' || o_orderkey || '01/a.htm' as path,
       o_orderpriority as name, '\\$' || o_orderkey as escaped, lpad(cast(o_custkey % 1000 as varchar), greatest(4, 0), '0') as code
from o""")
def labels_format(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    value = F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 8) * \
        F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    base = F.nullif(F.col("o_custkey"), F.lit(0)) * F.lit(100.0)
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", scalar.money_label(value).alias("money"),
        scalar.fiscal_label(F.col("o_orderdate").cast("date")).alias("fy"),
        scalar.change_label(F.col("o_totalprice"), base).alias("change"),
        scalar.cik10(F.col("o_custkey")).alias("cik"),
        scalar.document_path(F.col("o_custkey"), F.concat(key, F.lit("-01")), F.lit("a.htm")).alias("path"),
        scalar.strip_state_suffix(F.concat("o_orderpriority", F.lit(" /DE/"))).alias("name"),
        scalar.escape_dollar(F.concat(F.lit("$"), key)).alias("escaped"),
        scalar.code_text(F.concat((F.col("o_custkey") % 1000).cast("string"), F.lit(".0")), 4).alias("code"))
