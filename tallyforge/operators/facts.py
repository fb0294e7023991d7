"""Choice of usable facts: consolidated dollar values over clean periods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.taxonomy import taxonomy_df


@dataclass(frozen=True)
class FormSpec:
    """How many periods of a form are kept and how long one period may be."""

    form: str
    periods: int
    min_days: int
    max_days: int
    span_days: int

    @property
    def min_coverage(self) -> int:
        return min(2, self.periods)

    @property
    def window_days(self) -> int:
        return self.span_days * (self.periods - 1) + 60


def form_spec(form: str, periods: int) -> FormSpec:
    """Fiscal years for 10-K; discrete quarters for every other form."""
    if form == "10-K":
        return FormSpec(form, periods, 340, 390, 380)
    return FormSpec(form, periods, 80, 100, 98)


ANNUAL = form_spec("10-K", 5)
QUARTERLY = form_spec("10-Q", 8)


def per_form(specs: list[FormSpec], attribute: str) -> Column:
    """CASE form WHEN ... THEN <attribute>; a literal if there is one form."""
    if len(specs) == 1:
        return F.lit(getattr(specs[0], attribute))
    out = F.when(F.col("form") == specs[0].form, F.lit(getattr(specs[0], attribute)))
    for spec in specs[1:]:
        out = out.when(F.col("form") == spec.form, F.lit(getattr(spec, attribute)))
    return out


def usable_facts(facts: DataFrame, specs: list[FormSpec]) -> DataFrame:
    """Facts of a known line item in a wanted form, with a period of the right length.

    The equality filters reach the scan.  The taxonomy has 64 constant rows, so
    the join never shuffles the facts.
    """
    kept = facts.filter((F.col("taxonomy") == "us-gaap") & (F.col("unit") == "USD")
                        & F.col("form").isin([s.form for s in specs])
                        & F.col("period_end").isNotNull())
    tags = F.broadcast(taxonomy_df(facts.sparkSession)
                       .select("tag", "line_item", "statement", "kind", "tag_rank"))
    days = F.datediff("period_end", "period_start")
    clean = (F.col("kind") == "instant") | days.between(per_form(specs, "min_days"),
                                                       per_form(specs, "max_days"))
    return kept.join(tags, "tag").filter(clean)


def latest_filed(facts: DataFrame) -> DataFrame:
    """One row per (ticker, form, tag, period end): the value filed last.

    The order is total, so restated values with the same filing date resolve the
    same way in every run.  Spark cuts each map task's copies of a group to one
    row (WindowGroupLimit) before the shuffle, and the shuffle key is the whole
    group key, so neither a hot company nor a hot fact gathers its copies in a task.
    """
    newest = Window.partitionBy("ticker", "form", "tag", "period_end").orderBy(
        F.col("filed").desc_nulls_last(), F.col("accn").desc_nulls_last(),
        F.col("period_start").desc_nulls_last(), F.col("val").desc_nulls_last())
    return (facts.withColumn("_rn", F.row_number().over(newest))
            .filter("_rn = 1").drop("_rn"))
