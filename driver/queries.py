"""Queries over facts, statements, ratios and flags, each over whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver import fixtures as fx
from driver.registry import iso, query
from tallyforge.operators import facts as facts_ops
from tallyforge.operators import flags as flag_ops
from tallyforge.operators import ratios as ratio_ops
from tallyforge.operators import statements as stmt_ops
from tallyforge.operators.facts import ANNUAL, QUARTERLY

def annual_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stmt_ops.build_statements(fx.facts(spark, sf_dir), [ANNUAL])


def annual_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stmt_ops.to_wide(annual_statements(spark, sf_dir))


def annual_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide annual rows with ratios."""
    return ratio_ops.with_ratios(annual_wide(spark, sf_dir))


# ---- facts and statements ---------------------------------------------------

@query
def facts_filtered(spark, sf_dir):
    usable = facts_ops.usable_facts(fx.facts(spark, sf_dir), [ANNUAL, QUARTERLY])
    return iso(usable.select("ticker", "form", "tag", "line_item", "statement", "period_end",
                             "val", "filed", "accn"))


@query
def facts_latest_filed(spark, sf_dir):
    usable = facts_ops.usable_facts(fx.facts(spark, sf_dir), [ANNUAL, QUARTERLY])
    return iso(facts_ops.latest_filed(usable).select(
        "ticker", "form", "tag", "period_end", "val", "filed", "accn"))


@query
def tag_choice(spark, sf_dir):
    specs = [ANNUAL, QUARTERLY]
    latest = facts_ops.latest_filed(facts_ops.usable_facts(fx.facts(spark, sf_dir), specs))
    return (stmt_ops.choose_tags(latest, specs)
            .groupBy("ticker", "form", "line_item", F.col("tag").alias("tag_used"))
            .agg(F.count(F.lit(1)).alias("n_periods")))


@query
def statements_annual(spark, sf_dir):
    return iso(annual_statements(spark, sf_dir))


@query
def statements_quarterly(spark, sf_dir):
    return iso(stmt_ops.build_statements(fx.facts(spark, sf_dir), [QUARTERLY]))


@query
def tag_provenance(spark, sf_dir):
    return stmt_ops.tag_provenance(annual_statements(spark, sf_dir))


@query
def statements_wide(spark, sf_dir):
    return iso(annual_wide(spark, sf_dir))


@query
def statements_wide_quarterly(spark, sf_dir):
    return iso(stmt_ops.to_wide(
        stmt_ops.build_statements(fx.facts(spark, sf_dir), [QUARTERLY])))


# ---- ratios and flags ---------------------------------------------------------

RATIO_GROUPS = {
    "ratios_liquidity_leverage": ratio_ops.RATIO_COLUMNS[0:6],
    "ratios_profitability_dupont": ratio_ops.RATIO_COLUMNS[6:16],
    "ratios_efficiency": ratio_ops.RATIO_COLUMNS[16:20],
    "ratios_cash_growth": ratio_ops.RATIO_COLUMNS[20:31],
}


def _ratio_query(name: str, columns: list[str]) -> None:
    def run(spark, sf_dir):
        return iso(ratio_ops.compute_ratios(annual_wide(spark, sf_dir))
                   .select("ticker", "period_end", *columns))
    run.__name__ = name
    query(run)


for _name, _columns in RATIO_GROUPS.items():
    _ratio_query(_name, _columns)


@query
def dupont_audit(spark, sf_dir):
    return ratio_ops.dupont_audit(annual_periods(spark, sf_dir))


@query
def red_flags(spark, sf_dir):
    return iso(flag_ops.red_flags(annual_periods(spark, sf_dir))
               .select("ticker", "period_end", "rule_id", "severity"))


@query
def red_flag_metrics(spark, sf_dir):
    flags = flag_ops.red_flags(annual_periods(spark, sf_dir))
    return iso(flags.select("ticker", "period_end", "rule_id",
                            F.explode("metrics").alias("metric", "value")))


@query
def flag_heatmap(spark, sf_dir):
    return flag_ops.flag_heatmap(annual_periods(spark, sf_dir)) \
        .withColumn("n_flags", F.col("n_flags").cast("double"))
