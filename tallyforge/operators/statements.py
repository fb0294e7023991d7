"""Statements: choice of tag, newest periods, and the wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.scalar import sum_min_one
from tallyforge.operators.facts import FormSpec, latest_filed, per_form, usable_facts
from tallyforge.taxonomy import LINE_ITEMS

STATEMENT_COLUMNS = ["ticker", "statement", "line_item", "period_end", "fiscal_year",
                     "fiscal_period", "form", "value", "tag_used", "filed"]


def choose_tags(latest: DataFrame, specs: list[FormSpec],
                coverage_window: bool = False, by_ticker: bool = False) -> DataFrame:
    """Keep, per (ticker, form, line item), the rows of one tag.

    The first tag in fallback order with enough periods wins; if none has
    enough, the first tag with any.  Coverage counts all history; with
    ``coverage_window`` only periods inside the company's trailing window count.

    Input rows are unique per (ticker, form, tag, period end), so a company has
    at most 64 tags times its calendar of period ends: the per-ticker
    partitioning chosen here stays small whatever the raw volume.  All later
    windows and the pivot have the ticker in their key and reuse it.  Rows that
    are dealt by ticker already (``by_ticker``) stay where they are.
    """
    by_tag = Window.partitionBy("ticker", "form", "line_item", "tag")
    by_item = Window.partitionBy("ticker", "form", "line_item")
    rows = latest if by_ticker else latest.repartition("ticker")
    if coverage_window:
        newest = F.max("period_end").over(Window.partitionBy("ticker", "form"))
        counted = F.col("period_end") >= F.date_sub(newest, per_form(specs, "window_days"))
        rows = rows.withColumn("_n", F.count(F.when(counted, 1)).over(by_tag))
    else:
        rows = rows.withColumn("_n", F.count(F.lit(1)).over(by_tag))
    enough = F.when(F.col("_n") >= per_form(specs, "min_coverage"), F.col("tag_rank"))
    any_rows = F.when(F.col("_n") > 0, F.col("tag_rank"))
    wanted = F.coalesce(F.min(enough).over(by_item), F.min(any_rows).over(by_item))
    return (rows.withColumn("_rank", wanted)
            .filter("tag_rank = _rank").drop("_rank", "_n"))


def newest_periods(rows: DataFrame, specs: list[FormSpec]) -> DataFrame:
    """The newest N periods per line item, inside the company's trailing window."""
    newest = (Window.partitionBy("ticker", "form", "line_item")
              .orderBy(F.col("period_end").desc()))
    company = Window.partitionBy("ticker", "form")
    return (rows.withColumn("_rn", F.row_number().over(newest))
            .filter(F.col("_rn") <= per_form(specs, "periods"))
            .withColumn("_max_end", F.max("period_end").over(company))
            .filter(F.col("period_end") >= F.date_sub("_max_end", per_form(specs, "window_days")))
            .drop("_rn", "_max_end"))


def build_statements(facts: DataFrame, specs: list[FormSpec],
                     coverage_window: bool = False, by_ticker: bool = False) -> DataFrame:
    """Facts -> one row per (ticker, form, line item, period end).

    Several forms are built in one pass over the facts; ``form`` is part of
    every key.  Two shuffles: the restatement dedupe and the ticker partitioning;
    none over a table of ``write_colocated`` with ``by_ticker``.
    """
    usable = usable_facts(facts, specs).select(
        "ticker", "form", "tag", "line_item", "statement", "tag_rank", "period_start",
        "period_end", "val", "fy", "fp", "filed", "accn")
    chosen = choose_tags(latest_filed(usable), specs, coverage_window, by_ticker)
    return newest_periods(chosen, specs).select(
        "ticker", "statement", "line_item", "period_end",
        F.col("fy").alias("fiscal_year"), F.col("fp").alias("fiscal_period"), "form",
        F.col("val").alias("value"), F.col("tag").alias("tag_used"), "filed")


def tag_provenance(statements: DataFrame) -> DataFrame:
    """Number of periods each tag contributes to a line item."""
    return (statements.groupBy("ticker", "line_item", "tag_used")
            .agg(F.count(F.lit(1)).alias("n_periods")))


def to_wide(statements: DataFrame, keys: tuple[str, ...] = ("ticker", "period_end")) -> DataFrame:
    """One row per company and period, one column per line item, derived items filled.

    A (company, period, item) has one row after ``build_statements``, so ``max``
    of the matching value is that value and the pivot is one hash aggregation.
    Periods whose values are all missing do not appear.
    """
    # Expression text keeps the plan cheap to build for this many columns.
    cells = [F.expr(f"max(CASE WHEN line_item = '{item}' THEN value END)").alias(item)
             for item in LINE_ITEMS]
    wide = statements.filter(F.col("value").isNotNull()).groupBy(*keys).agg(*cells)
    filled = {
        "gross_profit": "coalesce(gross_profit, revenue - cost_of_revenue) AS gross_profit",
        "total_liabilities": "coalesce(total_liabilities, total_assets - stockholders_equity) "
                             "AS total_liabilities",
    }
    debt = sum_min_one("short_term_debt", "long_term_debt")
    return wide.selectExpr(*keys, *[filled.get(i, i) for i in LINE_ITEMS],
                           f"{debt} AS total_debt")
