"""Schemas of the stored tables, as DDL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.taxonomy import LINE_ITEMS

FACTS = ("ticker STRING, taxonomy STRING, tag STRING, label STRING, unit STRING, "
         "period_start DATE, period_end DATE, val DOUBLE, fy BIGINT, fp STRING, "
         "form STRING, filed DATE, frame STRING, accn STRING")
COMPANIES = ("ticker STRING, cik BIGINT, entity_name STRING, n_fact_rows BIGINT, "
             "fetched_at TIMESTAMP")
FILINGS = ("ticker STRING, cik BIGINT, form STRING, accession_number STRING, "
           "filing_date DATE, report_date DATE, primary_document STRING")
PROFILE = ("ticker STRING, cik BIGINT, entity_name STRING, sic STRING, "
           "sic_description STRING, website STRING, state_of_incorporation STRING, "
           "fiscal_year_end STRING, hq_street STRING, hq_city STRING, hq_state STRING, "
           "hq_zip STRING, phone STRING, exchange STRING")
MDNA = ("ticker STRING, cik BIGINT, form STRING, accession_number STRING, "
        "filing_date DATE, mdna_text STRING, char_count BIGINT, extraction_ok BOOLEAN")
SEGMENTS = ("ticker STRING, accession_number STRING, axis STRING, member STRING, "
            "label STRING, value DOUBLE, period_start DATE, period_end DATE")
STATEMENTS = ("ticker STRING, statement STRING, line_item STRING, period_end DATE, "
              "fiscal_year BIGINT, fiscal_period STRING, form STRING, value DOUBLE, "
              "tag_used STRING, filed DATE")
WIDE = ("ticker STRING, period_end DATE, "
        + ", ".join(f"{item} DOUBLE" for item in LINE_ITEMS) + ", total_debt DOUBLE")
CHUNKS = ("ticker STRING, form STRING, filing_date DATE, accession_number STRING, "
          "chunk_id INT, chunk_text STRING")
ANOMALIES = ("ticker STRING, period_end DATE, rule_id STRING, severity STRING, "
             "explanation STRING, metrics MAP<STRING, DOUBLE>")

#: The document that a company's facts come from, and the companies that an ingestion changed.
VERSIONS = "ticker STRING, file_time BIGINT, file_path STRING"
CHANGES = "run STRING, ticker STRING"


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """An empty table with a stable schema."""
    return spark.createDataFrame([], ddl)
