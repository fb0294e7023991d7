"""Price history and the price card."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.top import top_per_key

KEPT_ROWS = 1260        # five years of trading days
MIN_PRIMARY_ROWS = 10


def choose_source(prices: DataFrame, primary: str, secondary: str) -> DataFrame:
    """Rows of the primary source if it has more than ten, else of the secondary.

    Counts are pre-aggregated per ticker and joined back, so the rows of a
    heavily quoted ticker are never gathered for the decision.
    """
    enough = (prices.filter(F.col("source") == primary).groupBy("ticker")
              .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > MIN_PRIMARY_ROWS)
              .select("ticker", F.lit(True).alias("_primary")))
    wanted = F.when(F.col("_primary"), F.lit(primary)).otherwise(F.lit(secondary))
    return (prices.join(enough, "ticker", "left")
            .filter(F.col("source") == wanted).drop("_primary"))


def recent_prices(prices: DataFrame, kept: int = KEPT_ROWS) -> DataFrame:
    """The newest ``kept`` rows per ticker; ``rank_from_newest`` is 1 on the newest row.

    The rows of a ticker are dealt to parts by date and cut there first, so a
    ticker with most of the quotes is not sorted by one task.
    """
    return top_per_key(prices, ["ticker"], [F.col("date").desc(), F.col("close").desc()], kept,
                       "rank_from_newest", deal_by=["date"])


def latest_shares(shares: DataFrame) -> DataFrame:
    """Newest reported share count per ticker; ties by filing date, then accession."""
    newest = Window.partitionBy("ticker").orderBy(
        F.col("period_end").desc(), F.col("filed").desc_nulls_last(),
        F.col("accn").desc_nulls_last())
    return (shares.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1")
            .select("ticker", F.col("val").alias("shares")))


def shares_outstanding(facts: DataFrame) -> DataFrame:
    """Share counts out of the fact table."""
    return latest_shares(facts.filter(
        (F.col("taxonomy") == "dei") & (F.col("tag") == "EntityCommonStockSharesOutstanding")))


def price_card(prices: DataFrame, shares: DataFrame) -> DataFrame:
    """Last close, day change, 52-week range and market cap per ticker."""
    company = Window.partitionBy("ticker")
    rows = recent_prices(prices).withColumn("_newest", F.max("date").over(company))
    year = F.when(F.datediff("_newest", "date") <= 365, F.col("close"))
    rank = F.col("rank_from_newest")
    card = rows.groupBy("ticker").agg(
        F.max(F.when(rank == 1, F.col("close"))).alias("last_close"),
        F.max(F.when(rank == 2, F.col("close"))).alias("_previous"),
        F.max(year).alias("high_52w"), F.min(year).alias("low_52w"))
    return (card.join(shares, "ticker", "left")
            .select("ticker", "last_close",
                    (F.try_divide("last_close", "_previous") - 1).alias("day_change"),
                    "high_52w", "low_52w",
                    # A zero share count shows no market cap.
                    F.when(F.col("shares") != 0, F.col("last_close") * F.col("shares"))
                    .alias("market_cap")))
