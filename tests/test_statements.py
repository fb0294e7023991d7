import math

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import flags, income, periods, ratios, statements
from tallyforge.operators.facts import ANNUAL, QUARTERLY, form_spec
from tallyforge.taxonomy import LINE_ITEMS, TAGS
from tests.conftest import MILLION, PLANTED, company, fact, facts_df, planted_facts


def build(spark, rows, spec=ANNUAL, **kw):
    return statements.build_statements(facts_df(spark, rows), [spec], **kw)


def by_period(df, column):
    return {str(r.period_end): r[column] for r in df.collect()}


def all_periods(spark, rows, **kw):
    return ratios.with_ratios(statements.to_wide(build(spark, rows)), **kw)


def fired(spark, rows, year="2025"):
    found = flags.red_flags(all_periods(spark, rows))
    return {r.rule_id: r.severity for r in found.collect() if str(r.period_end).startswith(year)}


def test_taxonomy_size():
    assert len(TAGS) == 64 and len(set(TAGS)) == 64 and len(LINE_ITEMS) == 28


def test_restated_value_and_fallback_tag(spark):
    revenue = build(spark, planted_facts()).filter("line_item = 'revenue'").collect()
    values = {str(r.period_end): r.value for r in revenue}
    assert len(values) == 3 and values["2023-12-31"] == 1005 * MILLION
    assert {r.tag_used for r in revenue} == {"Revenues"}
    assert {str(r.period_end): r.fiscal_year for r in revenue}["2023-12-31"] == 2025


def test_filing_tie_is_resolved_by_accession(spark):
    rows = company() + [fact("TEST", "Revenues", 2024, 1, accn="acc-A"),
                        fact("TEST", "Revenues", 2024, 2, accn="acc-Z")]
    for order in (rows, rows[::-1]):
        revenue = build(spark, order).filter("line_item = 'revenue'")
        assert by_period(revenue, "value")["2024-12-31"] == 2 * MILLION


def test_other_units_taxonomies_forms_and_lengths_are_left_out(spark):
    rows = company() + [
        fact("TEST", "GrossProfit", 2024, 9, unit="EUR"),
        fact("TEST", "GrossProfit", 2024, 9, taxonomy="ifrs-full"),
        fact("TEST", "GrossProfit", 2024, 9, form="10-K/A"),
        fact("TEST", "GrossProfit", 2024, 9, start="2024-07-01"),
    ]
    assert build(spark, rows).filter("line_item = 'gross_profit'").count() == 0


def test_quarterly_drops_cumulative_periods(spark):
    rows = [fact("Q", "Revenues", 2024, 5, form="10-Q", start="2024-04-01", end="2024-06-30"),
            fact("Q", "Revenues", 2024, 9, form="10-Q", start="2024-01-01", end="2024-06-30"),
            fact("Q", "Assets", 2024, 7, form="10-Q", duration=False, end="2024-06-30")]
    tidy = build(spark, rows, QUARTERLY)
    assert {(r.line_item, r.value / MILLION) for r in tidy.collect()} == \
        {("revenue", 5.0), ("total_assets", 7.0)}


def test_tag_with_old_coverage_wins_unless_coverage_is_windowed(spark):
    new = [fact("SW", "RevenueFromContractWithCustomerIncludingAssessedTax", y, 10) for y in (2023, 2024)]
    old = [fact("SW", "RevenueFromContractWithCustomerExcludingAssessedTax", y, 1) for y in (2010, 2011)]
    base = [fact("SW", "Assets", y, 3, duration=False) for y in (2023, 2024)]
    tidy = build(spark, new + old + base)
    assert tidy.filter("line_item = 'revenue'").count() == 0
    windowed = build(spark, new + old + base, coverage_window=True)
    assert windowed.filter("line_item = 'revenue'").count() == 2


def test_single_period_tag_is_used_if_no_other(spark):
    tidy = build(spark, company() + [fact("TEST", "ProfitLoss", 2024, 1),
                                     fact("TEST", "CostsAndExpenses", 2024, 4)])
    used = {r.line_item: r.tag_used for r in tidy.collect()}
    assert used["operating_expenses"] == "CostsAndExpenses"
    assert used["net_income"] == "NetIncomeLoss"


def test_newest_periods_and_window(spark):
    rows = [fact("W", "Assets", y, y, duration=False) for y in range(2010, 2026)]
    rows += [fact("W", "Revenues", y, y) for y in (2019, 2020, 2025)]
    tidy = build(spark, rows)
    years = lambda item: sorted(r.period_end.year for r in tidy.filter(f"line_item = '{item}'").collect())
    assert years("total_assets") == [2021, 2022, 2023, 2024, 2025]
    assert years("revenue") == [2025]
    assert form_spec("10-K", 5).window_days == 1580 and form_spec("10-Q", 8).window_days == 746


def test_result_does_not_depend_on_order_or_partitions(spark):
    rows = planted_facts()
    one = build(spark, rows).collect()
    df = facts_df(spark, rows[::-1]).repartition(7)
    other = statements.build_statements(df, [ANNUAL]).collect()
    assert sorted(map(str, one)) == sorted(map(str, other))


def test_two_forms_in_one_pass_equal_single_passes(spark):
    rows = planted_facts() + [fact("TEST", "Revenues", 2024, 5, form="10-Q", start="2024-04-01",
                                   end=e) for e in ("2024-06-30",)]
    both = statements.build_statements(facts_df(spark, rows), [ANNUAL, QUARTERLY]).collect()
    single = build(spark, rows).collect() + build(spark, rows, QUARTERLY).collect()
    assert sorted(map(str, both)) == sorted(map(str, single))


def test_wide_has_all_items_and_derived_values(spark):
    wide = statements.to_wide(build(spark, planted_facts()))
    assert wide.columns == ["ticker", "period_end", *LINE_ITEMS, "total_debt"]
    assert by_period(wide, "gross_profit")["2024-12-31"] == 440 * MILLION
    assert by_period(wide, "total_liabilities")["2024-12-31"] == 1210 * MILLION
    assert by_period(wide, "total_debt")["2024-12-31"] is None


def test_all_null_period_vanishes(spark):
    rows = company() + [fact("NUL", "Assets", y, None, duration=False) for y in (2023, 2024)]
    wide = statements.to_wide(build(spark, rows))
    assert wide.filter("ticker = 'NUL'").count() == 0


def test_total_debt_needs_one_side(spark):
    rows = company() + [fact("TEST", "DebtCurrent", y, 7, duration=False) for y in (2024, 2025)]
    wide = statements.to_wide(build(spark, rows))
    assert by_period(wide, "total_debt")["2025-12-31"] == 7 * MILLION


def test_ratios_of_planted_company(spark):
    rows = {str(r.period_end): r for r in all_periods(spark, planted_facts()).collect()}
    last = rows["2025-12-31"]
    assert last.current_ratio == pytest.approx(968 / 605)
    assert last.revenue_growth == pytest.approx(0.1)
    assert last.roe == pytest.approx(181 / ((1089 + 990) / 2))
    assert last.dupont_roe_check == pytest.approx(last.roe, abs=1e-12)
    assert last.free_cash_flow == 72 * MILLION
    assert rows["2023-12-31"].revenue_growth is None
    assert rows["2023-12-31"].roa == pytest.approx(150 / 2000)
    assert last.interest_coverage is None


def test_zero_base_gives_null(spark):
    years = {**PLANTED, 2025: (0, 726, 242, 181, 0, 968, 0, 1089, 165, 145, 72, 300),
             2024: (0, 660, 220, 165, 0, 880, 550, 990, 110, 132, 200, 300)}
    rows = {r.period_end.year: r for r in all_periods(spark, company("ZERO", years)).collect()}
    assert rows[2025].current_ratio is None and rows[2025].net_margin is None
    assert rows[2025].revenue_growth is None and rows[2025].roa is None
    assert not any(isinstance(v, float) and (math.isnan(v) or math.isinf(v)) for v in rows[2025])


def test_gap_option_nulls_growth(spark):
    rows = [r for r in company() if not r["period_end"].startswith("2024")]
    plain = {r.period_end.year: r for r in all_periods(spark, rows).collect()}
    strict = {r.period_end.year: r for r in all_periods(spark, rows, max_gap_days=400).collect()}
    assert plain[2025].revenue_growth == pytest.approx(0.21)
    assert strict[2025].revenue_growth is None


def test_dupont_audit(spark):
    rows = all_periods(spark, planted_facts())
    audit = ratios.dupont_audit(rows).first()
    assert audit.dupont_ok and audit.n_checked == 3
    broken = rows.withColumn("roe", F.col("roe") + 1)
    assert not ratios.dupont_audit(broken).first().dupont_ok


def with_last(**changes):
    """The planted company with other values in 2025."""
    names = ("revenue", "cost", "operating", "net", "assets", "current_assets",
             "current_liabilities", "equity", "receivables", "inventory", "ocf", "cash")
    last = dict(zip(names, PLANTED[2025])) | changes
    return company("RULE", {**PLANTED, 2025: tuple(last[n] for n in names)})


def test_planted_flags(spark):
    found = fired(spark, planted_facts())
    assert found == {"ar_outpaces_revenue": "high", "earnings_not_backed_by_cash": "high"}


@pytest.mark.parametrize("changes, rule, severity", [
    ({"receivables": 130}, "ar_outpaces_revenue", None),
    ({"receivables": 140}, "ar_outpaces_revenue", "medium"),
    ({"ocf": 120}, "earnings_not_backed_by_cash", "medium"),
    ({"ocf": -10}, "earnings_not_backed_by_cash", None),
    ({"inventory": 180}, "inventory_buildup", "medium"),
    ({"cost": 800}, "margin_compression", "medium"),
    ({"current_assets": 550}, "current_ratio_below_1", "medium"),
    ({"current_assets": 400}, "current_ratio_below_1", "high"),
    ({"equity": -2000}, "negative_equity", "high"),
    ({"revenue": 900}, "revenue_decline", "info"),
    ({"revenue": 1000}, "revenue_decline", None),
])
def test_each_rule(spark, changes, rule, severity):
    assert fired(spark, with_last(**changes)).get(rule) == severity


def test_leverage_rule(spark):
    rows = company() + [fact("TEST", "LongTermDebt", y, v, duration=False)
                        for y, v in ((2024, 900), (2025, 1200))]
    assert fired(spark, rows)["leverage_spike"] == "medium"


def test_flag_count_equals_flags_and_heatmap(spark):
    rows = all_periods(spark, with_last(revenue=900, current_assets=400))
    flagged = flags.red_flags(rows)
    counted = {r.period_end: r.n for r in
               rows.select("period_end", F.expr(flags.flag_count()).alias("n")).collect()}
    listed = {}
    for r in flagged.collect():
        listed[r.period_end] = listed.get(r.period_end, 0) + 1
    assert {k: v for k, v in counted.items() if v} == listed
    cells = {(r.severity, r.fy): r.n_flags for r in flags.flag_heatmap(rows).collect()}
    from_flags = {(r.severity, r.fy): r.n_flags for r in flags.flag_counts(flagged).collect()}
    assert {k: v for k, v in cells.items() if v is not None} == from_flags
    assert {fy for _, fy in cells} == {"FY2023", "FY2024", "FY2025"}


def test_visible_flags_are_sorted(spark):
    rows = all_periods(spark, with_last(revenue=900, current_assets=400))
    shown = periods.recent_periods(rows, days=400)
    found = flags.visible_flags(flags.red_flags(rows), shown).collect()
    ends = [str(r.period_end) for r in found]
    assert ends == sorted(ends, reverse=True) and "2023-12-31" not in ends


def wide_row(spark, **values):
    cols = ", ".join(f"cast({values.get(i, 'null')} as double) as {i}" for i in LINE_ITEMS)
    return spark.sql(f"select 'T' as ticker, date '2025-12-31' as period_end, {cols}")


def edges(spark, **values):
    return {(r.source, r.target): r.value
            for r in income.income_flow_edges(wide_row(spark, **values)).collect()}


def test_flow_standard_with_loss_below_operating(spark):
    found = edges(spark, revenue=100, cost_of_revenue=40, gross_profit=60, operating_income=20,
                  rd_expense=10, sga_expense=20, pretax_income=15, income_tax_expense=5, net_income=10)
    assert found[("Operating expenses", "Other opex")] == 10
    assert found[("Operating income", "Non-operating costs")] == 5
    assert found[("Pre-tax income", "Income tax")] == 5
    assert ("Operating income", "Net income") not in found


def test_flow_without_pretax_goes_straight_to_net_income(spark):
    found = edges(spark, revenue=100, cost_of_revenue=40, gross_profit=60, operating_income=20,
                  net_income=25)
    assert found[("Operating income", "Net income")] == 20


def test_flow_bank_shape(spark):
    found = edges(spark, revenue=100, pretax_income=30, income_tax_expense=0, net_income=30,
                  operating_expenses=72, compensation_expense=40)
    assert found[("Revenue", "Operating expenses")] == 72
    assert found[("Operating expenses", "Other expenses")] == 32
    assert found[("Pre-tax income", "Income tax")] == 1e-9


def test_flow_none_for_losses_but_bridge_works(spark):
    row = dict(revenue=100, net_income=-5, pretax_income=-5, operating_expenses=104)
    assert edges(spark, **row) == {}
    steps = income.income_bridge_steps(wide_row(spark, **row)).orderBy("step_no").collect()
    assert [(s.label, s.value, s.measure) for s in steps] == [
        ("Revenue", 100, "absolute"), ("Operating expenses", -104, "relative"), ("Net income", -5, "total")]


def test_segment_edges_residual_and_inconsistent(spark):
    newest = wide_row(spark, revenue=100, net_income=10, cost_of_revenue=40, gross_profit=60,
                      operating_income=20)
    seg = lambda *v: spark.createDataFrame([("T", f"S{i}", float(x)) for i, x in enumerate(v)],
                                           "ticker string, label string, value double")
    found = {r.source: r.value for r in income.segment_edges(newest, seg(50, 30)).collect()}
    assert found == {"S0": 50, "S1": 30, "Other": 20}
    assert {r.source for r in income.segment_edges(newest, seg(60, 41)).collect()} == {"S0", "S1"}
    assert income.segment_edges(newest, seg(60, 50)).count() == 0


def test_common_size_needs_five_quarters_for_yoy(spark):
    ends = ["2024-03-31", "2024-06-30", "2024-09-30", "2024-12-31", "2025-03-31"]
    rows = spark.createDataFrame([("T", "10-Q", e, float(10 + i)) for i, e in enumerate(ends)]
                                 + [("T", "10-K", "2023-12-31", 30.0), ("T", "10-K", "2024-12-31", 45.0)],
                                 "ticker string, form string, period_end string, revenue double")
    wide = rows.withColumn("period_end", F.col("period_end").cast("date")).select(
        "*", *[F.lit(None).cast("double").alias(i) for i in LINE_ITEMS if i != "revenue"])
    quarter = {str(r.period_end): r for r in periods.common_size(wide, quarterly=True).collect()}
    assert quarter["2025-03-31"].yoy == pytest.approx(0.4) and quarter["2024-12-31"].yoy is None
    assert quarter["2025-03-31"].qoq == pytest.approx(1 / 13)
    annual = {str(r.period_end): r for r in periods.common_size(wide).collect()}
    assert annual["2024-12-31"].yoy == pytest.approx(0.5)
    assert annual["2024-12-31"].qoq == pytest.approx(1 / 13) and annual["2023-12-31"].qoq is None
    choice = periods.period_choice(wide).first()
    assert choice.quarter_offered


def test_metrics_from_stored_tables_equal_those_from_periods(spark):
    from tallyforge.operators import peers
    rows = all_periods(spark, planted_facts())
    wide = rows.select("ticker", "period_end", *LINE_ITEMS, "total_debt")
    stored = peers.latest_metrics_of_tables(wide, ratios.compute_ratios(wide)).collect()
    assert stored == peers.latest_metrics(rows).collect()
