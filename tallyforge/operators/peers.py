"""Comparison inside an industry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.periods import latest_row


def latest_metrics(periods: DataFrame) -> DataFrame:
    """Newest revenue and ratios per company, from wide rows with ratios."""
    return latest_row(periods).select("ticker", "revenue", "net_margin", "roe", "debt_to_equity")


def latest_metrics_of_tables(wide: DataFrame, ratios: DataFrame) -> DataFrame:
    """The same from the stored wide and ratio tables, which may end differently."""
    w = latest_row(wide).select("ticker", "revenue")
    r = latest_row(ratios).select("ticker", "net_margin", "roe", "debt_to_equity")
    return w.join(r, "ticker", "full_outer")


def industry_table(profiles: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per company with its industry code and newest figures.

    The output grows with the companies, not with the pairs of companies; a
    comparison for one subject is a filter on its industry code.
    """
    named = profiles.filter(F.coalesce(F.col("sic"), F.lit("")) != "")
    return named.join(metrics, "ticker", "left").select(
        "sic", "ticker", "entity_name", "revenue", "net_margin", "roe", "debt_to_equity")


def peer_comparison(subjects: DataFrame, profiles: DataFrame, metrics: DataFrame) -> DataFrame:
    """Subject first, then every company of the same industry.

    ``subjects`` has one row (sic, subject) per comparison.  Each comparison
    costs one pass over its industry, as in the table for a single company.
    """
    table = industry_table(profiles, metrics)
    joined = table.join(subjects.select("sic", "subject"), "sic")
    return joined.select(
        "subject", F.when(F.col("ticker") == F.col("subject"), 0).otherwise(1)
        .cast("bigint").alias("peer_order"),
        "sic", "ticker", "entity_name", "revenue", "net_margin", "roe", "debt_to_equity")


def industry_leaders(roster: DataFrame, registry: DataFrame, catalog: DataFrame,
                     n: int = 5) -> DataFrame:
    """Top companies by market cap per industry, with a mark for ingested ones.

    ``roster`` (sic, company, cik, market_cap) lists filers, ``registry`` maps
    cik to ticker, ``catalog`` holds the ingested tickers.  Only the top n per
    map task are shuffled (WindowGroupLimit), so a crowded industry is no hot spot.
    """
    size = Window.partitionBy("sic").orderBy(F.col("market_cap").desc(), "ticker")
    listed = (roster.join(registry.select("cik", "ticker"), "cik")
              .filter(F.col("ticker").isNotNull() & F.col("market_cap").isNotNull()))
    top = (listed.withColumn("rank", F.row_number().over(size).cast("bigint"))
           .filter(F.col("rank") <= n))
    known = catalog.select("ticker").distinct().withColumn("_known", F.lit(True))
    return (top.join(known, "ticker", "left")
            .select("sic", "rank", "company", "ticker", "market_cap",
                    F.col("_known").isNotNull().alias("in_catalog")))
