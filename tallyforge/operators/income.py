"""Income statement as flow edges and as bridge steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tolerances of the flow and the smallest drawn edge.
RESIDUAL_SHARE = 0.02       # an unexplained rest below this share is not shown
OPEX_TOLERANCE = 0.15       # reported total expenses must be this close to revenue - pre-tax
SEGMENT_LOW, SEGMENT_HIGH = 0.98, 1.05
SMALLEST = 1e-9


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _edge(source: str, target: str, value: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"),
                    F.greatest(value, F.lit(SMALLEST)).alias("value"))


def _total_expenses(tolerance_base: Column) -> Column:
    implied = F.col("revenue") - F.col("pretax_income")
    reported = F.col("operating_expenses")
    near = F.abs(reported - implied) < tolerance_base * OPEX_TOLERANCE
    return F.when(near, reported).otherwise(implied)


def income_flow_edges(wide: DataFrame) -> DataFrame:
    """(ticker, period_end, source, target, value), no rows for non-positive flows.

    Standard filers split gross profit into expenses; filers without cost of
    revenue (banks) split revenue into pre-tax income and expenses.
    """
    rev, ni, cogs, gp, oi, pti, tax, comp = (F.col(c) for c in (
        "revenue", "net_income", "cost_of_revenue", "gross_profit", "operating_income",
        "pretax_income", "income_tax_expense", "compensation_expense"))
    rd, sga = F.col("rd_expense"), F.col("sga_expense")
    standard = _true((cogs > 0) & (gp > 0) & (oi > 0))
    financial = ~standard & _true((pti > 0) & (pti <= rev) & (tax >= 0))
    rows = wide.filter((rev > 0) & (ni > 0)).filter(standard | financial).select(
        "ticker", "period_end", "revenue", "net_income", "cost_of_revenue", "gross_profit",
        "operating_income", "pretax_income", "income_tax_expense", "compensation_expense",
        "rd_expense", "sga_expense", "operating_expenses", standard.alias("_standard"),
        (gp - oi).alias("_opex"), _total_expenses(rev).alias("_total_opex"))
    opex, total = F.col("_opex"), F.col("_total_opex")
    zero = F.lit(0.0)
    rows = rows.withColumn("_rd", F.when((rd > 0) & (rd <= opex * 1.02), rd).otherwise(zero))
    rows = rows.withColumn("_sga", F.when(
        (sga > 0) & (F.col("_rd") + sga <= opex * 1.02), sga).otherwise(zero))
    rows = rows.withColumn("_known", F.col("_rd") + F.col("_sga"))
    known, std = F.col("_known"), F.col("_standard")
    taxed = std & _true((pti > 0) & (tax >= 0))
    gain = taxed & _true(pti >= oi)
    loss = taxed & ~_true(pti >= oi)
    bank = ~std
    paid = bank & _true((comp > 0) & (comp <= total))

    def only(cond: Column, source: str, target: str, value: Column) -> Column:
        return F.when(cond, _edge(source, target, value))

    edges = F.array(
        only(std, "Revenue", "Gross profit", gp),
        only(std, "Revenue", "Cost of revenue", cogs),
        only(std, "Gross profit", "Operating income", oi),
        only(std, "Gross profit", "Operating expenses", opex),
        only(std & (F.col("_rd") > 0), "Operating expenses", "R&D", rd),
        only(std & (F.col("_sga") > 0), "Operating expenses", "SG&A", sga),
        only(std & (known > 0) & (opex - known > opex * RESIDUAL_SHARE),
             "Operating expenses", "Other opex", opex - known),
        only(gain, "Operating income", "Pre-tax income", oi),
        only(gain, "Non-operating income", "Pre-tax income", pti - oi),
        only(loss, "Operating income", "Pre-tax income", pti),
        only(loss, "Operating income", "Non-operating costs", oi - pti),
        only(std & ~taxed, "Operating income", "Net income", F.least(ni, oi)),
        only(bank, "Revenue", "Pre-tax income", pti),
        only(bank, "Revenue", "Operating expenses", total),
        only(paid, "Operating expenses", "Compensation & benefits", comp),
        only(paid & (total - comp > total * RESIDUAL_SHARE),
             "Operating expenses", "Other expenses", total - comp),
        only(taxed | bank, "Pre-tax income", "Net income", ni),
        only(taxed | bank, "Pre-tax income", "Income tax", tax))
    return (rows.select("ticker", "period_end", F.inline(edges))
            .filter(F.col("source").isNotNull()))


def segment_edges(newest: DataFrame, segments: DataFrame) -> DataFrame:
    """Edges segment -> Revenue for the newest annual row of each company.

    Totals are pre-aggregated; a rest below 98 % of revenue becomes "Other";
    segments that add up to more than 105 % are dropped as inconsistent.
    """
    drawable = _true((F.col("cost_of_revenue") > 0) & (F.col("gross_profit") > 0)
                     & (F.col("operating_income") > 0)) \
        | _true((F.col("pretax_income") > 0) & (F.col("pretax_income") <= F.col("revenue"))
                & (F.col("income_tax_expense") >= 0))
    base = newest.filter((F.col("revenue") > 0) & (F.col("net_income") > 0)).filter(drawable) \
        .select("ticker", "period_end", "revenue")
    totals = segments.groupBy("ticker").agg(F.sum("value").alias("_total"))
    entries = (segments.join(totals, "ticker").select("ticker", "label", "value", "_total")
               .unionByName(totals.select("ticker", F.lit(None).cast("string").alias("label"),
                                          F.lit(None).cast("double").alias("value"), "_total")))
    rev, total = F.col("revenue"), F.col("_total")
    rest = F.col("label").isNull()
    return (base.join(entries, "ticker")
            .filter(total <= rev * SEGMENT_HIGH)
            .filter(~rest | (total < rev * SEGMENT_LOW))
            .select("ticker", "period_end", F.coalesce("label", F.lit("Other")).alias("source"),
                    F.lit("Revenue").alias("target"),
                    F.greatest(F.when(rest, rev - total).otherwise(F.col("value")),
                               F.lit(SMALLEST)).alias("value")))


def income_bridge_steps(wide: DataFrame) -> DataFrame:
    """(ticker, period_end, step_no, label, value, measure); works for losses."""
    rev, ni, cogs, gp, oi, pti, tax, opex = (F.col(c) for c in (
        "revenue", "net_income", "cost_of_revenue", "gross_profit", "operating_income",
        "pretax_income", "income_tax_expense", "operating_expenses"))
    full = cogs.isNotNull() & gp.isNotNull() & oi.isNotNull()
    bank = ~full & pti.isNotNull()
    total_only = ~full & pti.isNull() & opex.isNotNull()

    def step(cond: Column, label: str, value: Column, measure: str = "relative") -> Column:
        return F.when(cond, F.struct(F.lit(label).alias("label"), value.alias("value"),
                                     F.lit(measure).alias("measure")))

    always = F.lit(True)
    steps = F.filter(F.array(
        step(always, "Revenue", rev, "absolute"),
        step(full, "Cost of revenue", -cogs),
        step(full, "Operating expenses", -(gp - oi)),
        step(full & pti.isNotNull(), "Non-operating, net", pti - oi),
        step(bank, "Operating expenses", -_total_expenses(F.abs(rev))),
        step(total_only, "Operating expenses", -opex),
        step(tax.isNotNull(), "Income tax", -tax),
        step(always, "Net income", ni, "total")), lambda x: x.isNotNull())
    return (wide.filter(rev.isNotNull() & ni.isNotNull()).filter(full | bank | total_only)
            .select("ticker", "period_end", F.posexplode(steps).alias("pos", "s"))
            .select("ticker", "period_end", (F.col("pos") + 1).cast("bigint").alias("step_no"),
                    "s.label", "s.value", "s.measure"))
