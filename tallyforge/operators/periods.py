"""Per-company row selection and growth tables over the wide rows.

The frames here carry ``form``; an annual-only frame works as well.  Every
window has the ticker in its key, so rows that come out of ``to_wide`` are not
shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.scalar import change_sql, fiscal_label
from tallyforge.operators.flags import flag_count

ANNUAL_DAYS = 1898      # int(5.2 * 365)
QUARTERLY_DAYS = 839    # int(2.3 * 365)


def both_forms(wide: DataFrame, wide_q: DataFrame) -> DataFrame:
    """Stored annual and quarterly wide tables as one frame with ``form``."""
    return (wide.withColumn("form", F.lit("10-K"))
            .unionByName(wide_q.withColumn("form", F.lit("10-Q"))))


def recent_periods(rows: DataFrame, keys: tuple[str, ...] = ("ticker",),
                   days: Column | int = ANNUAL_DAYS) -> DataFrame:
    """Rows not older than ``days`` before the newest row of their key."""
    newest = F.max("period_end").over(Window.partitionBy(*keys))
    age = F.datediff("_newest", "period_end")
    return rows.withColumn("_newest", newest).filter(age <= days).drop("_newest")


def recent_by_form(rows: DataFrame) -> DataFrame:
    days = F.when(F.col("form") == "10-K", ANNUAL_DAYS).otherwise(QUARTERLY_DAYS)
    return recent_periods(rows, ("ticker", "form"), days)


def latest_row(rows: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """The newest row of each key."""
    newest = Window.partitionBy(*keys).orderBy(F.col("period_end").desc())
    return rows.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def kpi_row(periods: DataFrame) -> DataFrame:
    """Headline figures of the newest period of each company.

    Flags are counted on the ratio row itself, so no second pass over the
    statements and no join is needed.
    """
    by_company = Window.partitionBy("ticker").orderBy("period_end")
    rows = recent_periods(periods).select(
        "ticker", "period_end", "revenue", "net_income", "revenue_growth", "net_income_growth",
        "roe", ((F.col("roe") - F.lag("roe").over(by_company)) * 100).alias("roe_change_pp"),
        "net_margin",
        ((F.col("net_margin") - F.lag("net_margin").over(by_company)) * 100)
        .alias("net_margin_change_pp"),
        F.expr(flag_count()).alias("n_flags"))
    return latest_row(rows)


def period_choice(wide: DataFrame) -> DataFrame:
    """Newest annual and quarterly period; a quarter is offered only if it is newer."""
    ends = wide.groupBy("ticker").agg(
        F.max(F.when(F.col("form") == "10-K", F.col("period_end"))).alias("annual_end"),
        F.max(F.when(F.col("form") == "10-Q", F.col("period_end"))).alias("quarter_end"))
    return ends.filter(F.col("annual_end").isNotNull()).select(
        "ticker", "annual_end", "quarter_end",
        F.coalesce(F.col("quarter_end") > F.col("annual_end"), F.lit(False))
        .alias("quarter_offered"))


def chosen_period(wide: DataFrame) -> DataFrame:
    """One row per company: its newest quarter if that is newer than its fiscal year, else the year."""
    company = Window.partitionBy("ticker")
    year = F.max(F.when(F.col("form") == "10-K", F.col("period_end"))).over(company)
    quarter = F.max(F.when(F.col("form") == "10-Q", F.col("period_end"))).over(company)
    newer = F.coalesce(F.col("_quarter") > F.col("_year"), F.lit(False))
    return (wide.withColumn("_year", year).withColumn("_quarter", quarter)
            .filter(F.col("_year").isNotNull())
            .filter((F.col("form") == F.when(newer, "10-Q").otherwise("10-K"))
                    & (F.col("period_end") == F.when(newer, F.col("_quarter")).otherwise(F.col("_year"))))
            .drop("_year", "_quarter"))


# Income statement lines of the common-size table, in order.
COMMON_SIZE_ITEMS = {
    "revenue": "Revenue",
    "cost_of_revenue": "Cost of revenue",
    "gross_profit": "Gross profit",
    "rd_expense": "R&D expense",
    "sga_expense": "SG&A expense",
    "operating_income": "Operating income",
    "pretax_income": "Pre-tax income",
    "income_tax_expense": "Income tax",
    "net_income": "Net income",
}


def common_size(wide: DataFrame, quarterly: bool = False) -> DataFrame:
    """Value, share of revenue, YoY and QoQ per income statement line.

    Annual view: YoY against the prior annual row; QoQ of the newest row
    compares the two newest quarters.  Quarterly view: YoY four rows back, QoQ
    one row back.  Both forms come in one frame, so the quarters of the annual
    view are found with a window instead of a join.
    """
    series = "OVER (PARTITION BY ticker, form ORDER BY period_end)"
    newest = "OVER (PARTITION BY ticker, form ORDER BY period_end DESC)"
    items = list(COMMON_SIZE_ITEMS)
    base = recent_by_form(wide).select("ticker", "form", "period_end", *items)
    rows = base.selectExpr("*", f"row_number() {newest} AS _rn",
                           *[f"lag({i}, {n}) {series} AS _p{n}_{i}" for i in items for n in (1, 4)])
    if quarterly:
        rows = rows.filter("form = '10-Q'")
        yoy = {i: change_sql(i, f"_p4_{i}") for i in items}
        qoq = {i: change_sql(i, f"_p1_{i}") for i in items}
    else:
        rows = rows.selectExpr("*", *[
            f"max(CASE WHEN form = '10-Q' AND _rn = {n} THEN {i} END) "
            f"OVER (PARTITION BY ticker) AS _q{n}_{i}" for i in items for n in (1, 2)]) \
            .filter("form = '10-K'")
        yoy = {i: change_sql(i, f"_p1_{i}") for i in items}
        qoq = {i: f"CASE WHEN _rn = 1 THEN {change_sql(f'_q1_{i}', f'_q2_{i}')} END" for i in items}
    lines = ", ".join(
        f"CASE WHEN {i} IS NOT NULL THEN named_struct('line_item', '{name}', 'value', {i}, "
        f"'share_of_revenue', try_divide({i}, revenue), 'yoy', {yoy[i]}, 'qoq', {qoq[i]}) END"
        for i, name in COMMON_SIZE_ITEMS.items())
    return (rows.selectExpr("ticker", "period_end", "_rn = 1 AS is_newest",
                            f"inline(array({lines}))")
            .filter("line_item IS NOT NULL"))


# Chart families as (family, metric, column expression).
TREND_FAMILIES = [
    ("Earnings", "revenue", "revenue"),
    ("Earnings", "operating_income", "operating_income"),
    ("Earnings", "net_income", "net_income"),
    ("Margins", "gross_margin", "gross_margin"),
    ("Margins", "operating_margin", "operating_margin"),
    ("Margins", "net_margin", "net_margin"),
    ("Cash cycle", "dso_days", "dso_days"),
    ("Cash cycle", "dio_days", "dio_days"),
    ("Cash cycle", "dpo_days", "-dpo_days"),
    ("Cash cycle", "cash_conversion_cycle_days", "cash_conversion_cycle_days"),
    ("Returns", "roe", "roe"),
    ("Returns", "roa", "roa"),
    ("Returns", "dupont_asset_turnover", "dupont_asset_turnover"),
    ("Growth", "revenue_growth", "revenue_growth"),
    ("Growth", "accounts_receivable_growth", "accounts_receivable_growth"),
    ("Profit vs cash", "net_income", "net_income"),
    ("Profit vs cash", "operating_cash_flow", "operating_cash_flow"),
]


def trend_series(periods: DataFrame) -> DataFrame:
    """Six families of (fiscal year, metric, value) per company.

    A metric the company never reports in the visible years is dropped; the cash
    cycle is shown as a whole if receivable or inventory days exist.
    """
    metrics = list(dict.fromkeys(m for _, m, _ in TREND_FAMILIES))
    rows = recent_periods(periods).selectExpr(
        "ticker", "period_end", *metrics,
        *[f"count({m}) OVER (PARTITION BY ticker) AS _n_{m}" for m in metrics])

    def shown(family: str, metric: str) -> str:
        return "_n_dso_days > 0 OR _n_dio_days > 0" if family == "Cash cycle" \
            else f"_n_{metric} > 0"

    points = ", ".join(
        f"CASE WHEN {shown(family, metric)} THEN named_struct('family', '{family}', "
        f"'metric', '{metric}', 'value', {sql}) END" for family, metric, sql in TREND_FAMILIES)
    return (rows.select("ticker", "period_end", fiscal_label(F.col("period_end")).alias("fy"),
                        F.expr(f"inline(array({points}))"))
            .filter("family IS NOT NULL"))
