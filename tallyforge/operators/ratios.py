"""The 31 ratios, declared as formulas over the wide statement row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Balances averaged over two periods; the current value if there is no prior one.
AVERAGED = ["total_assets", "stockholders_equity", "accounts_receivable", "inventory",
            "accounts_payable"]
GROWTH = ["revenue", "net_income", "accounts_receivable", "inventory", "cost_of_revenue",
          "operating_cash_flow", "total_debt"]

# ratio = formula.  try_divide gives null for a zero base.
# avg_<item> is the two-period average, prev_<item> the prior row's value.
# Each block may use the ratios of the blocks before it.
_LEVEL_ONE = {
    "current_ratio": "try_divide(current_assets, current_liabilities)",
    "quick_ratio": "try_divide(current_assets - coalesce(inventory, 0), current_liabilities)",
    "cash_ratio": "try_divide(cash_and_equivalents, current_liabilities)",
    "debt_to_equity": "try_divide(total_debt, stockholders_equity)",
    "liabilities_to_assets": "try_divide(total_liabilities, total_assets)",
    "interest_coverage": "try_divide(operating_income, interest_expense)",
    "gross_margin": "try_divide(gross_profit, revenue)",
    "operating_margin": "try_divide(operating_income, revenue)",
    "net_margin": "try_divide(net_income, revenue)",
    "effective_tax_rate": "try_divide(income_tax_expense, pretax_income)",
    "roa": "try_divide(net_income, avg_total_assets)",
    "roe": "try_divide(net_income, avg_stockholders_equity)",
    "dupont_net_margin": "try_divide(net_income, revenue)",
    "dupont_asset_turnover": "try_divide(revenue, avg_total_assets)",
    "dupont_equity_multiplier": "try_divide(avg_total_assets, avg_stockholders_equity)",
    "dso_days": "try_divide(365 * avg_accounts_receivable, revenue)",
    "dio_days": "try_divide(365 * avg_inventory, cost_of_revenue)",
    "dpo_days": "try_divide(365 * avg_accounts_payable, cost_of_revenue)",
    "ocf_to_net_income": "try_divide(operating_cash_flow, net_income)",
    "free_cash_flow": "operating_cash_flow - coalesce(capex, 0)",
    "accruals_ratio": "try_divide(net_income - operating_cash_flow, avg_total_assets)",
}
_LEVEL_TWO = {
    "dupont_roe_check": "dupont_net_margin * dupont_asset_turnover * dupont_equity_multiplier",
    "cash_conversion_cycle_days": "dso_days + dio_days - dpo_days",
    "fcf_margin": "try_divide(free_cash_flow, revenue)",
}
RATIO_COLUMNS = [
    "current_ratio", "quick_ratio", "cash_ratio", "debt_to_equity", "liabilities_to_assets",
    "interest_coverage", "gross_margin", "operating_margin", "net_margin",
    "effective_tax_rate", "roa", "roe", "dupont_net_margin", "dupont_asset_turnover",
    "dupont_equity_multiplier", "dupont_roe_check", "dso_days", "dio_days", "dpo_days",
    "cash_conversion_cycle_days", "ocf_to_net_income", "free_cash_flow", "fcf_margin",
    "accruals_ratio", *[f"{item}_growth" for item in GROWTH]]
RATIO_SCHEMA = "ticker STRING, period_end DATE, " + ", ".join(f"{name} DOUBLE" for name in RATIO_COLUMNS)


def with_ratios(wide: DataFrame, keys: tuple[str, ...] = ("ticker",),
                max_gap_days: int | None = None) -> DataFrame:
    """Wide rows plus the ratio columns and ``prior_gross_margin``.

    The prior period is the prior row of the company.  With ``max_gap_days``
    growth is null where that row lies further back.  One window over the
    partitioning the pivot already has.
    """
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY period_end)"
    lagged = dict.fromkeys([*AVERAGED, *GROWTH, "gross_profit", "period_end"])
    near = "true" if max_gap_days is None else \
        f"datediff(period_end, prev_period_end) <= {max_gap_days}"
    out = wide.selectExpr("*", *[f"lag({c}) {over} AS prev_{c}" for c in lagged])
    out = out.selectExpr("*", *[f"coalesce(({c} + prev_{c}) / 2, {c}) AS avg_{c}"
                                for c in AVERAGED])
    out = out.selectExpr(
        "*", *[f"{sql} AS {name}" for name, sql in _LEVEL_ONE.items()],
        *[f"CASE WHEN {near} THEN try_divide({c} - prev_{c}, abs(prev_{c})) END AS {c}_growth"
          for c in GROWTH],
        "try_divide(prev_gross_profit, prev_revenue) AS prior_gross_margin")
    out = out.selectExpr("*", *[f"{sql} AS {name}" for name, sql in _LEVEL_TWO.items()])
    return out.select(*wide.columns, *RATIO_COLUMNS, "prior_gross_margin")


def compute_ratios(wide: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """One row per company and period with the ratio columns only."""
    return with_ratios(wide, keys).select(*keys, "period_end", *RATIO_COLUMNS)


def with_prior_margin(ratios: DataFrame) -> DataFrame:
    """Attach the prior row's gross margin to a stored ratio table."""
    prior_row = Window.partitionBy("ticker").orderBy("period_end")
    return ratios.withColumn("prior_gross_margin", F.lag("gross_margin").over(prior_row))


def dupont_metrics(tolerance: float = 1e-6) -> dict[str, Column]:
    """Aggregates over ratio rows: rows checked, the largest gap, and whether the DuPont product equals ROE."""
    gap = F.max(F.abs(F.col("dupont_roe_check") - F.col("roe")))
    return {"n_checked": F.count("dupont_roe_check"), "dupont_gap": gap,
            "dupont_ok": F.coalesce(gap < tolerance, F.lit(True))}


def dupont_audit(ratios: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: does the DuPont product equal ROE on every row?"""
    metrics = dupont_metrics(tolerance)
    return ratios.agg(*[metrics[name].alias(name) for name in ("n_checked", "dupont_ok")])
