"""Ticker registry, work list and failure report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.scalar import key_list, normal_ticker, valid_ticker


def requested_keys(lists: DataFrame, column: str) -> DataFrame:
    """A column of comma lists -> distinct normalized tickers."""
    return lists.select(F.explode(key_list(F.col(column))).alias("ticker")).distinct()


def first_registry_entry(registry: DataFrame) -> DataFrame:
    """One entry per ticker: the first in document order (``pos``)."""
    first = Window.partitionBy("ticker").orderBy("pos")
    return (registry.withColumn("ticker", F.upper("ticker"))
            .withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn"))


def lookup_tickers(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests with cik and title; null where the ticker is unknown.

    No broadcast hint: Spark broadcasts the registry by its measured size.
    """
    return (requests.withColumn("ticker", normal_ticker(F.col("ticker")))
            .join(first_registry_entry(registry).select("ticker", "cik", "title"),
                  "ticker", "left"))


def rejects(looked_up: DataFrame) -> DataFrame:
    return looked_up.filter(F.col("cik").isNull()).select("ticker")


def validate_tickers(requests: DataFrame, registry: DataFrame, ingested: DataFrame) -> DataFrame:
    """Status per request: invalid, already_available, unknown or accepted."""
    asked = requests.select(normal_ticker(F.col("ticker")).alias("ticker")).distinct()
    known = registry.select(F.upper("ticker").alias("ticker")).distinct() \
        .withColumn("_known", F.lit(True))
    have = ingested.select("ticker").distinct().withColumn("_have", F.lit(True))
    status = (F.when(~valid_ticker(F.col("ticker")), "invalid")
              .when(F.col("_have"), "already_available")
              .when(F.col("_known").isNull(), "unknown").otherwise("accepted"))
    return (asked.join(have, "ticker", "left").join(known, "ticker", "left")
            .select("ticker", status.alias("status")))


def work_list(requested: DataFrame, ingested: DataFrame,
              include_existing: bool = True) -> DataFrame:
    """Requested tickers, and those already ingested unless excluded."""
    keys = requested.select("ticker")
    if include_existing:
        keys = keys.union(ingested.select("ticker"))
    return keys.distinct()


def failure_report(work: DataFrame, landed: DataFrame, requested: DataFrame) -> DataFrame:
    """Tickers that did not land, and whether they were asked for in this run."""
    failed = work.select("ticker").distinct().join(landed.select("ticker"), "ticker", "left_anti")
    asked = requested.select("ticker").distinct().withColumn("_asked", F.lit(True))
    return (failed.join(asked, "ticker", "left")
            .select("ticker", F.col("_asked").isNotNull().alias("requested")))


def fail_on_requested(report: DataFrame) -> None:
    """Raise if a requested ticker failed; names all of them.

    The names are one text made by Spark, as long as the request list of a run.
    """
    bad = report.filter("requested").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("ticker")), ", ").alias("names")).first()
    if bad.n:
        raise RuntimeError(f"{bad.n} requested tickers failed to ingest: {bad.names}")
