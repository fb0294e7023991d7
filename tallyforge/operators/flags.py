"""Red flags: eight rules over a ratio row, declared as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalar import fiscal_label


@dataclass(frozen=True)
class Rule:
    rule_id: str
    condition: str
    severity: str
    metrics: tuple[str, ...]
    explanation: str


# Rule ids, conditions, severity tiers and metric names.  A
# comparison with a missing operand is null and the rule does not fire.
RULES = [
    Rule("ar_outpaces_revenue",
         "accounts_receivable_growth > revenue_growth + 0.10D AND accounts_receivable_growth > 0",
         "CASE WHEN accounts_receivable_growth > revenue_growth + 0.25D THEN 'high' ELSE 'medium' END",
         ("revenue_growth", "accounts_receivable_growth", "dso_days"),
         "Customers owe more and more relative to what was sold: receivables rose well "
         "ahead of sales, so part of the reported growth is still unpaid."),
    Rule("earnings_not_backed_by_cash",
         "ocf_to_net_income > 0 AND ocf_to_net_income < 0.8D",
         "CASE WHEN ocf_to_net_income < 0.5D THEN 'high' ELSE 'medium' END",
         ("ocf_to_net_income", "accruals_ratio"),
         "Only part of the reported profit arrived as operating cash; the rest is "
         "accounting accruals that may reverse later."),
    Rule("inventory_buildup",
         "inventory_growth > cost_of_revenue_growth + 0.15D AND inventory_growth > 0",
         "'medium'",
         ("inventory_growth", "cost_of_revenue_growth", "dio_days"),
         "Stock on hand expanded faster than the cost of what was sold, a hint at slow "
         "moving goods and possible write-downs."),
    Rule("margin_compression",
         "revenue_growth > 0 AND gross_margin < prior_gross_margin - 0.03D",
         "'medium'",
         ("revenue_growth", "gross_margin", "prior_gross_margin"),
         "Sales went up while the gross margin lost more than three points: the extra "
         "revenue was bought with lower prices or higher costs."),
    Rule("current_ratio_below_1",
         "current_ratio < 1.0D",
         "CASE WHEN current_ratio < 0.8D THEN 'high' ELSE 'medium' END",
         ("current_ratio", "quick_ratio"),
         "Obligations due within a year are larger than the assets that can be turned "
         "into cash in that time."),
    Rule("leverage_spike",
         "total_debt_growth > 0.30D AND debt_to_equity > 1.0D",
         "'medium'",
         ("total_debt_growth", "debt_to_equity", "interest_coverage"),
         "Borrowing climbed by more than thirty percent and is now larger than the "
         "owners' capital."),
    Rule("negative_equity",
         "dupont_equity_multiplier < 0",
         "'high'",
         ("dupont_equity_multiplier",),
         "On average over the period the company owed more than it owned, which makes "
         "the usual leverage figures meaningless."),
    Rule("revenue_decline",
         "revenue_growth < -0.10D",
         "'info'",
         ("revenue_growth",),
         "Sales shrank by more than ten percent against the period before."),
]
SEVERITIES = ["high", "medium", "info"]


def _fired(rule: Rule) -> str:
    """SQL of the flag a rule raises; null if it does not fire."""
    metrics = ", ".join(f"'{m}', {m}" for m in rule.metrics)
    text = rule.explanation.replace("'", "\\'")
    return (f"CASE WHEN {rule.condition} THEN named_struct('rule_id', '{rule.rule_id}', "
            f"'severity', {rule.severity}, 'explanation', '{text}', 'metrics', map({metrics})) END")


def red_flags(ratios: DataFrame, keys: tuple[str, ...] = ("ticker", "period_end")) -> DataFrame:
    """Zero to eight rows per company-period; no shuffle, no row loop.

    Needs ``prior_gross_margin`` next to the ratios.
    """
    return (ratios.selectExpr(*keys, f"inline(array({', '.join(map(_fired, RULES))}))")
            .filter("rule_id IS NOT NULL"))


def flag_count() -> str:
    """SQL of the number of rules that fire on a ratio row, without building the flags."""
    hits = " + ".join(f"CASE WHEN {r.condition} THEN 1L ELSE 0L END" for r in RULES)
    return f"({hits})"


def severity_rank(severity: Column) -> Column:
    """1 = high, 2 = medium, 3 = info."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def flag_counts(flags: DataFrame) -> DataFrame:
    """Number of flags per (ticker, severity, fiscal year), one row per cell that fired."""
    return (flags.groupBy("ticker", "severity", fiscal_label(F.col("period_end")).alias("fy"))
            .agg(F.count(F.lit(1)).alias("n_flags")))


def flag_heatmap(periods: DataFrame) -> DataFrame:
    """Severity by fiscal year for every company, from ratio rows.

    Rows: the severities that fired for the company.  Columns: all its fiscal
    years; an empty cell is null.  One pass: count per year, see per company
    which severities fired at all, unpivot.
    """
    def fired(severity: str) -> str:
        hits = " + ".join(f"CASE WHEN ({r.condition}) AND ({r.severity}) = '{severity}' "
                          "THEN 1L ELSE 0L END" for r in RULES)
        return f"sum({hits})"

    years = (periods.groupBy("ticker", fiscal_label(F.col("period_end")).alias("fy"))
             .agg(*[F.expr(fired(s)).alias(s) for s in SEVERITIES]))
    cells = ", ".join(f"CASE WHEN max({s}) OVER (PARTITION BY ticker) > 0 THEN "
                      f"named_struct('severity', '{s}', 'n_flags', nullif({s}, 0L)) END"
                      for s in SEVERITIES)
    return (years.selectExpr("ticker", "fy", f"array({cells}) AS cells")
            .select("ticker", "fy", F.inline("cells"))
            .filter(F.col("severity").isNotNull())
            .select("ticker", "severity", "fy", "n_flags"))


def sorted_flags(flags: DataFrame) -> DataFrame:
    """Newest period first, then severity by name."""
    return flags.orderBy("ticker", F.col("period_end").desc(), "severity", "rule_id")


def visible_flags(flags: DataFrame, periods: DataFrame) -> DataFrame:
    """Stored flags cut to the periods still shown."""
    shown = periods.select("ticker", "period_end").distinct()
    return sorted_flags(flags.join(shown, ["ticker", "period_end"], "left_semi"))
