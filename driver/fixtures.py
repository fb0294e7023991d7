"""Stand-ins for the domain tables, derived by Spark from the driver tables.

Each function maps whole tables row by row (or with a keyed aggregation); the
SQL in ``driver/oracle.py`` derives the same rows for the other engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.tables import spread
from tallyforge.taxonomy import TAGS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are expensive to process, dealt by its key, the first column."""
    rows = table(spark, sf_dir, name)
    return spread(rows, rows.columns[0])


def ticker_of(key) -> F.Column:
    return F.concat(F.lit("S"), F.lpad(key.cast("string"), 5, "0"))


def whole_ticker_of(key) -> F.Column:
    """Of a key of more than five digits no digit is cut, so that every key has a ticker of its own."""
    digits = key.cast("string")
    return F.concat(F.lit("S"), F.lpad(digits, F.greatest(F.length(digits), F.lit(5)), F.lit("0")))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact per line item row; suppliers are companies."""
    d = F.col("l_shipdate").cast("date")
    rows = table(spark, sf_dir, "lineitem").withColumns({
        "d": d,
        "form": F.when(F.col("l_returnflag") == "N", "10-Q").otherwise("10-K"),
    })
    quarter_end = F.last_day(F.make_date(F.year("d"), F.quarter("d") * 3, F.lit(1)))
    rows = rows.withColumn("period_end", F.when(
        F.col("form") == "10-K", F.make_date(F.year("d"), F.lit(12), F.lit(31)))
        .otherwise(quarter_end))
    length = (F.when(F.col("l_linenumber") == 7, 180)
              .when(F.col("form") == "10-K", 364).otherwise(90))
    tag = F.element_at(F.split(F.lit(" ".join(TAGS)), " "), (F.col("l_partkey") % 64 + 1).cast("int"))
    return rows.select(
        ticker_of(F.col("l_suppkey")).alias("ticker"),
        F.when(F.col("l_tax") == 0.08, "ifrs-full").otherwise("us-gaap").alias("taxonomy"),
        tag.alias("tag"),
        F.when(F.col("l_discount") == 0.0, "shares").otherwise("USD").alias("unit"),
        F.date_sub("period_end", length).alias("period_start"),
        "period_end",
        (F.col("l_extendedprice") * F.when(
            (F.col("l_linestatus") == "O") & (F.col("l_discount") >= 0.09), -1).otherwise(1))
        .alias("val"),
        F.year("period_end").cast("bigint").alias("fy"),
        F.when(F.col("form") == "10-K", "FY")
        .otherwise(F.concat(F.lit("Q"), F.quarter("period_end").cast("string"))).alias("fp"),
        "form",
        F.date_add("period_end", F.col("l_quantity").cast("int")).alias("filed"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string")).alias("accn"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as companies; the nation stands in for the industry code."""
    return table(spark, sf_dir, "supplier").select(
        ticker_of(F.col("s_suppkey")).alias("ticker"), F.col("s_suppkey").alias("cik"),
        F.col("s_name").alias("entity_name"),
        F.lpad(F.col("s_nationkey").cast("string"), 4, "0").alias("sic"),
        F.col("s_acctbal").alias("market_cap"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten times the smallest amount per company and return flag as a revenue segment, whole dollars."""
    rows = table(spark, sf_dir, "lineitem")
    return (rows.groupBy(ticker_of(F.col("l_suppkey")).alias("ticker"),
                         F.concat(F.lit("Line "), "l_returnflag").alias("label"))
            .agg(F.floor(F.min("l_extendedprice") * 10).cast("double").alias("value")))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One close per order priority and day."""
    return (table(spark, sf_dir, "orders")
            .groupBy(F.col("o_orderpriority").alias("ticker"),
                     F.col("o_orderdate").cast("date").alias("date"))
            .agg(F.max_by("o_totalprice", "o_orderkey").alias("close")))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("ticker"),
        F.col("o_orderdate").cast("date").alias("period_end"),
        F.col("o_custkey").cast("double").alias("val"),
        F.col("o_orderdate").cast("date").alias("filed"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("accn"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings of customers."""
    return table(spark, sf_dir, "orders").select(
        ticker_of(F.col("o_custkey")).alias("ticker"), F.col("o_custkey").alias("cik"),
        F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q")
        .otherwise("8-K").alias("form"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("accession_number"),
        F.col("o_orderdate").cast("date").alias("filing_date"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ask for a company: most keys are unknown to the registry."""
    raw = F.concat(F.lit(" s"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit(" "))
    odd = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("s-"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select(F.coalesce(odd, raw).alias("ticker"))
