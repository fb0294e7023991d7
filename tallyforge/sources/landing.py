"""Landed company documents: nested JSON and filing markup to flat rows.

Parsing functions take a DataFrame with the document text in a column, so they
serve files, tables and micro-batches alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalar import blank_to_null, normal_ticker
from tallyforge.operators.registry import first_registry_entry

_OBSERVATION = ("STRUCT<start: STRING, end: STRING, val: STRING, fy: STRING, fp: STRING, "
                "form: STRING, filed: STRING, frame: STRING, accn: STRING>")
FACTS_JSON = ("facts MAP<STRING, MAP<STRING, STRUCT<label: STRING, "
              f"units: MAP<STRING, ARRAY<{_OBSERVATION}>>>>>")
SUBMISSIONS_JSON = """
    sic STRING, sicDescription STRING, website STRING, stateOfIncorporation STRING,
    fiscalYearEnd STRING, phone STRING, exchanges ARRAY<STRING>,
    addresses STRUCT<business: STRUCT<street1: STRING, city: STRING, stateOrCountry: STRING,
                                      zipCode: STRING>>,
    filings STRUCT<recent: STRUCT<form: ARRAY<STRING>, accessionNumber: ARRAY<STRING>,
                                  filingDate: ARRAY<STRING>, reportDate: ARRAY<STRING>,
                                  primaryDocument: ARRAY<STRING>>>"""
REGISTRY_JSON = "MAP<STRING, STRUCT<cik_str: STRING, ticker: STRING, title: STRING>>"

# The forms kept in the filing index.
INDEXED_FORMS = ["10-K", "10-Q", "8-K", "DEF 14A"]


def file_stem(path: Column) -> Column:
    """'/landing/facts/aapl.json' -> 'aapl'."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows: (value, file_path, file_time)."""
    return (spark.read.format("text").option("wholetext", True).load(path)
            .select("value", F.col("_metadata.file_path").alias("file_path"),
                    F.col("_metadata.file_modification_time").alias("file_time")))


def read_company_documents(spark: SparkSession, path: str) -> DataFrame:
    """One landed file per company, named by its ticker."""
    docs = read_documents(spark, path)
    return docs.withColumn("ticker", normal_ticker(file_stem(F.col("file_path"))))


def read_filing_documents(spark: SparkSession, path: str) -> DataFrame:
    """Filing markup landed under cik/accession/document: (cik, accession_number, primary_document, html)."""
    docs = read_documents(spark, path)
    at = F.slice(F.split("file_path", "/"), -3, 3)
    dashed = F.regexp_replace(at[1], r"^(\d{10})(\d{2})(\d{6})$", "$1-$2-$3")
    return docs.select(at[0].try_cast("bigint").alias("cik"), dashed.alias("accession_number"),
                       F.url_decode(at[2]).alias("primary_document"), F.col("value").alias("html"))


def parse_facts(docs: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``facts``, the nested map; null where the text is not such a document."""
    return docs.withColumn("facts", F.from_json(column, FACTS_JSON)["facts"])


def flatten_facts(docs: DataFrame, column: str = "value") -> DataFrame:
    """One row per (taxonomy, tag, unit, observation); bad numbers and dates are null."""
    # Exploded as an expression: of an exploded column Spark would infer a filter
    # and push it below the parsing, which would then run twice.
    facts = F.from_json(column, FACTS_JSON)["facts"]
    return _observations(docs.select("ticker", F.explode(facts).alias("taxonomy", "tags")))


def facts_or_mark(docs: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``flatten_facts`` with ``readable`` and the columns ``keep``, parsed once.

    A document without observations, readable or not, leaves one row without a tag.
    """
    parsed = docs.select("ticker", *keep, F.from_json(column, FACTS_JSON)["facts"].alias("facts"))
    tags = parsed.select("ticker", *keep, F.col("facts").isNotNull().alias("readable"),
                         F.explode_outer("facts").alias("taxonomy", "tags"))
    return _observations(tags, ("readable", *keep), outer=True)


def _observations(tags: DataFrame, more: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    explode, inline = (F.explode_outer, F.inline_outer) if outer else (F.explode, F.inline)
    metas = tags.select("ticker", *more, "taxonomy", explode("tags").alias("tag", "meta"))
    units = metas.select("ticker", *more, "taxonomy", "tag", F.col("meta.label").alias("label"),
                         explode("meta.units").alias("unit", "observations"))
    rows = units.select("ticker", *more, "taxonomy", "tag", "label", "unit",
                        F.col("observations").isNotNull().alias("held"), inline("observations"))
    if outer:
        # A tag without observations is no fact.
        rows = rows.withColumn("tag", F.when(F.col("held"), F.col("tag")))
    return rows.select(
        *more, "ticker", "taxonomy", "tag", "label", "unit",
        F.col("start").try_cast("date").alias("period_start"),
        F.col("end").try_cast("date").alias("period_end"),
        F.nullif(F.col("val").try_cast("double"), F.lit(float("nan"))).alias("val"), F.col("fy").try_cast("bigint").alias("fy"),
        "fp", "form", F.col("filed").try_cast("date").alias("filed"), "frame", "accn")


def registry(docs: DataFrame, column: str = "value") -> DataFrame:
    """The ticker list as rows in document order: (pos, cik, ticker, title)."""
    entries = docs.select(F.posexplode(F.from_json(column, REGISTRY_JSON)).alias("pos", "k", "e"))
    return entries.select("pos", F.col("e.cik_str").try_cast("bigint").alias("cik"),
                          F.col("e.ticker").alias("ticker"), F.col("e.title").alias("title"))


def registry_by_cik(entries: DataFrame) -> DataFrame:
    """One ticker per cik: the last in document order."""
    return (entries.groupBy("cik").agg(F.max_by("ticker", "pos").alias("ticker"))
            .filter(F.col("cik").isNotNull()))


def parse_submissions(docs: DataFrame, column: str = "value") -> DataFrame:
    return docs.withColumn("s", F.from_json(column, SUBMISSIONS_JSON))


def filing_index(submissions: DataFrame) -> DataFrame:
    """Parallel arrays to one row per filing of an indexed form."""
    recent = F.col("s.filings.recent")
    rows = submissions.select("ticker", "cik", F.inline(F.arrays_zip(
        recent["form"].alias("form"), recent["accessionNumber"].alias("accession_number"),
        recent["filingDate"].alias("filing_date"), recent["reportDate"].alias("report_date"),
        recent["primaryDocument"].alias("primary_document"))))
    return rows.filter(F.col("form").isin(INDEXED_FORMS)).select(
        "ticker", "cik", "form", "accession_number",
        F.col("filing_date").try_cast("date").alias("filing_date"),
        blank_to_null(F.col("report_date")).try_cast("date").alias("report_date"),
        "primary_document")


def company_profile(submissions: DataFrame) -> DataFrame:
    """Identity, industry and business address; codes stay text."""
    office = F.col("s.addresses.business")
    return submissions.select(
        "ticker", "cik", "entity_name", F.coalesce("s.sic", F.lit("")).alias("sic"),
        F.col("s.sicDescription").alias("sic_description"),
        blank_to_null(F.col("s.website")).alias("website"),
        F.col("s.stateOfIncorporation").alias("state_of_incorporation"),
        F.col("s.fiscalYearEnd").alias("fiscal_year_end"),
        office["street1"].alias("hq_street"), office["city"].alias("hq_city"),
        office["stateOrCountry"].alias("hq_state"), office["zipCode"].alias("hq_zip"),
        F.col("s.phone").alias("phone"),
        F.try_element_at("s.exchanges", F.lit(1)).alias("exchange"))


def company_dimension(landed: DataFrame, entries: DataFrame, facts: DataFrame) -> DataFrame:
    """Landed tickers (ticker, fetched_at) with cik, name and number of facts."""
    counts = facts.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_fact_rows"))
    names = first_registry_entry(entries).select("ticker", "cik", F.col("title").alias("entity_name"))
    return (landed.join(names, "ticker").join(counts, "ticker", "left")
            .select("ticker", "cik", "entity_name",
                    F.coalesce("n_fact_rows", F.lit(0)).alias("n_fact_rows"), "fetched_at"))
