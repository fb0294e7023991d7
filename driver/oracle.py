"""SQL of another engine: the shared chain from facts to flags, and the queries on it."""

from __future__ import annotations

from driver.registry import ORACLE
from tallyforge.taxonomy import LINE_ITEMS, TAGS, taxonomy_values

TAX = f"""tax(tag_id, tag, line_item, statement, kind, tag_rank) as (values {taxonomy_values()})"""

FACTS = f"""b as (
  select *, cast(l_shipdate as date) as d,
         case when l_returnflag = 'N' then '10-Q' else '10-K' end as form
  from lineitem),
e as (
  select *, case when form = '10-K' then make_date(year(d), 12, 31)
                 else last_day(make_date(year(d), quarter(d) * 3, 1)) end as period_end
  from b),
fx as (
  select 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as ticker,
         case when l_tax = 0.08 then 'ifrs-full' else 'us-gaap' end as taxonomy,
         [{", ".join(f"'{t}'" for t in TAGS)}][l_partkey % 64 + 1] as tag,
         case when l_discount = 0.0 then 'shares' else 'USD' end as unit,
         cast(period_end - cast(case when l_linenumber = 7 then 180 when form = '10-K' then 364 else 90 end as int)
              as date) as period_start,
         period_end,
         l_extendedprice * case when l_linestatus = 'O' and l_discount >= 0.09 then -1 else 1 end as val,
         cast(year(period_end) as bigint) as fy,
         case when form = '10-K' then 'FY' else 'Q' || cast(quarter(period_end) as varchar) end as fp,
         form, cast(period_end + cast(l_quantity as int) as date) as filed,
         cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) || '-' || cast(l_partkey as varchar) as accn
  from e)"""

USABLE = """usable as (
  select fx.*, t.line_item, t.statement, t.kind, t.tag_rank
  from fx join tax t on fx.tag = t.tag
  where taxonomy = 'us-gaap' and unit = 'USD' and form in ('10-K', '10-Q')
    and (t.kind = 'instant'
         or (form = '10-K' and date_diff('day', period_start, period_end) between 340 and 390)
         or (form = '10-Q' and date_diff('day', period_start, period_end) between 80 and 100))),
latest as (
  select * from usable
  qualify row_number() over (partition by ticker, form, tag, period_end
    order by filed desc, accn desc, period_start desc, val desc) = 1),
counted as (select *, count(*) over (partition by ticker, form, tag) as n_ends from latest),
ranked as (
  select *, coalesce(min(case when n_ends >= 2 then tag_rank end) over (partition by ticker, form, line_item),
                     min(tag_rank) over (partition by ticker, form, line_item)) as chosen_rank
  from counted),
chosen as (select * from ranked where tag_rank = chosen_rank)"""

STATEMENTS = """recent as (
  select * from chosen
  qualify row_number() over (partition by ticker, form, line_item order by period_end desc)
          <= case when form = '10-K' then 5 else 8 end),
stmts as (
  select ticker, statement, line_item, period_end, fy as fiscal_year, fp as fiscal_period, form,
         val as value, tag as tag_used, filed
  from recent
  qualify date_diff('day', period_end, max(period_end) over (partition by ticker, form))
          <= case when form = '10-K' then 1580 else 746 end)"""

WIDE = ("pivoted as (select ticker, form, period_end, "
        + ", ".join(f"max(value) filter (where line_item = '{i}') as p_{i}" for i in LINE_ITEMS)
        + " from stmts where value is not null group by ticker, form, period_end),\n"
        "wide as (select ticker, form, period_end, "
        + ", ".join({
            "gross_profit": "coalesce(p_gross_profit, p_revenue - p_cost_of_revenue) as gross_profit",
            "total_liabilities": "coalesce(p_total_liabilities, p_total_assets - p_stockholders_equity) as total_liabilities",
        }.get(i, f"p_{i} as {i}") for i in LINE_ITEMS)
        + ", case when p_short_term_debt is null and p_long_term_debt is null then null "
          "else coalesce(p_short_term_debt, 0) + coalesce(p_long_term_debt, 0) end as total_debt "
          "from pivoted)")

_PREV = ["total_assets", "stockholders_equity", "accounts_receivable", "inventory",
         "accounts_payable", "revenue", "net_income", "cost_of_revenue", "operating_cash_flow",
         "total_debt", "gross_profit"]
_AVG = _PREV[:5]
_GROWTH = ["revenue", "net_income", "accounts_receivable", "inventory", "cost_of_revenue",
           "operating_cash_flow", "total_debt"]

RATIOS = ("lagged as (select *, "
          + ", ".join(f"lag({c}) over w as q_{c}" for c in _PREV)
          + " from wide window w as (partition by ticker, form order by period_end)),\n"
          "averaged as (select *, "
          + ", ".join(f"coalesce(({c} + q_{c}) / 2, {c}) as a_{c}" for c in _AVG)
          + " from lagged),\n"
          """r1 as (select *,
  current_assets / nullif(current_liabilities, 0) as current_ratio,
  (current_assets - coalesce(inventory, 0)) / nullif(current_liabilities, 0) as quick_ratio,
  cash_and_equivalents / nullif(current_liabilities, 0) as cash_ratio,
  total_debt / nullif(stockholders_equity, 0) as debt_to_equity,
  total_liabilities / nullif(total_assets, 0) as liabilities_to_assets,
  operating_income / nullif(interest_expense, 0) as interest_coverage,
  gross_profit / nullif(revenue, 0) as gross_margin,
  operating_income / nullif(revenue, 0) as operating_margin,
  net_income / nullif(revenue, 0) as net_margin,
  income_tax_expense / nullif(pretax_income, 0) as effective_tax_rate,
  net_income / nullif(a_total_assets, 0) as roa,
  net_income / nullif(a_stockholders_equity, 0) as roe,
  net_income / nullif(revenue, 0) as dupont_net_margin,
  revenue / nullif(a_total_assets, 0) as dupont_asset_turnover,
  a_total_assets / nullif(a_stockholders_equity, 0) as dupont_equity_multiplier,
  365 * a_accounts_receivable / nullif(revenue, 0) as dso_days,
  365 * a_inventory / nullif(cost_of_revenue, 0) as dio_days,
  365 * a_accounts_payable / nullif(cost_of_revenue, 0) as dpo_days,
  operating_cash_flow / nullif(net_income, 0) as ocf_to_net_income,
  operating_cash_flow - coalesce(capex, 0) as free_cash_flow,
  (net_income - operating_cash_flow) / nullif(a_total_assets, 0) as accruals_ratio,
  q_gross_profit / nullif(q_revenue, 0) as prior_gross_margin, """
          + ", ".join(f"({c} - q_{c}) / nullif(abs(q_{c}), 0) as {c}_growth" for c in _GROWTH)
          + " from averaged),\n"
          """ratios as (select *,
  dupont_net_margin * dupont_asset_turnover * dupont_equity_multiplier as dupont_roe_check,
  dso_days + dio_days - dpo_days as cash_conversion_cycle_days,
  free_cash_flow / nullif(revenue, 0) as fcf_margin
  from r1)""")

_RULES = [
    ("ar_outpaces_revenue", "accounts_receivable_growth > revenue_growth + 0.10::double and accounts_receivable_growth > 0",
     "case when accounts_receivable_growth > revenue_growth + 0.25::double then 'high' else 'medium' end",
     ["revenue_growth", "accounts_receivable_growth", "dso_days"]),
    ("earnings_not_backed_by_cash", "ocf_to_net_income > 0 and ocf_to_net_income < 0.8::double",
     "case when ocf_to_net_income < 0.5::double then 'high' else 'medium' end",
     ["ocf_to_net_income", "accruals_ratio"]),
    ("inventory_buildup", "inventory_growth > cost_of_revenue_growth + 0.15::double and inventory_growth > 0",
     "'medium'", ["inventory_growth", "cost_of_revenue_growth", "dio_days"]),
    ("margin_compression", "revenue_growth > 0 and gross_margin < prior_gross_margin - 0.03::double",
     "'medium'", ["revenue_growth", "gross_margin", "prior_gross_margin"]),
    ("current_ratio_below_1", "current_ratio < 1.0::double",
     "case when current_ratio < 0.8::double then 'high' else 'medium' end",
     ["current_ratio", "quick_ratio"]),
    ("leverage_spike", "total_debt_growth > 0.30::double and debt_to_equity > 1.0::double",
     "'medium'", ["total_debt_growth", "debt_to_equity", "interest_coverage"]),
    ("negative_equity", "dupont_equity_multiplier < 0", "'high'", ["dupont_equity_multiplier"]),
    ("revenue_decline", "revenue_growth < -0.10::double", "'info'", ["revenue_growth"]),
]
FLAGS = ("flags as ("
         + " union all ".join(
             f"select ticker, form, period_end, '{rule}' as rule_id, {sev} as severity from ratios where {cond}"
             for rule, cond, sev, _ in _RULES) + ")")

TO_STATEMENTS = f"with {TAX},\n{FACTS},\n{USABLE},\n{STATEMENTS}"
TO_WIDE = f"{TO_STATEMENTS},\n{WIDE}"
TO_RATIOS = f"{TO_WIDE},\n{RATIOS}"
TO_FLAGS = f"{TO_RATIOS},\n{FLAGS}"


def text(column: str) -> str:
    return f"cast({column} as varchar) as {column}"


# ---- facts and statements ---------------------------------------------------

_UP_TO_CHOSEN = f"with {TAX},\n{FACTS},\n{USABLE}"
ORACLE["facts_filtered"] = f"""{_UP_TO_CHOSEN}
select ticker, form, tag, line_item, statement, {text('period_end')}, val, {text('filed')}, accn from usable"""
ORACLE["facts_latest_filed"] = f"""{_UP_TO_CHOSEN}
select ticker, form, tag, {text('period_end')}, val, {text('filed')}, accn from latest"""
ORACLE["tag_choice"] = f"""{_UP_TO_CHOSEN}
select ticker, form, line_item, tag as tag_used, count(*) as n_periods from chosen group by all"""
_STMT = f"""select ticker, statement, line_item, {text('period_end')}, fiscal_year, fiscal_period, form,
value, tag_used, {text('filed')} from stmts"""
ORACLE["statements_annual"] = f"{TO_STATEMENTS} {_STMT} where form = '10-K'"
ORACLE["statements_quarterly"] = f"{TO_STATEMENTS} {_STMT} where form = '10-Q'"
ORACLE["tag_provenance"] = f"""{TO_STATEMENTS}
select ticker, line_item, tag_used, count(*) as n_periods from stmts where form = '10-K' group by all"""
_WIDE_SELECT = (f"select ticker, {text('period_end')}, " + ", ".join(LINE_ITEMS) + ", total_debt from wide")
ORACLE["statements_wide"] = f"{TO_WIDE} {_WIDE_SELECT} where form = '10-K'"
ORACLE["statements_wide_quarterly"] = f"{TO_WIDE} {_WIDE_SELECT} where form = '10-Q'"

# ---- ratios and flags ---------------------------------------------------------

_GROUPS = {
    "ratios_liquidity_leverage": ["current_ratio", "quick_ratio", "cash_ratio", "debt_to_equity",
                                  "liabilities_to_assets", "interest_coverage"],
    "ratios_profitability_dupont": ["gross_margin", "operating_margin", "net_margin",
                                    "effective_tax_rate", "roa", "roe", "dupont_net_margin",
                                    "dupont_asset_turnover", "dupont_equity_multiplier",
                                    "dupont_roe_check"],
    "ratios_efficiency": ["dso_days", "dio_days", "dpo_days", "cash_conversion_cycle_days"],
    "ratios_cash_growth": ["ocf_to_net_income", "free_cash_flow", "fcf_margin", "accruals_ratio",
                           *[f"{c}_growth" for c in _GROWTH]],
}
for _name, _cols in _GROUPS.items():
    ORACLE[_name] = (f"{TO_RATIOS} select ticker, {text('period_end')}, {', '.join(_cols)} "
                     "from ratios where form = '10-K'")
ORACLE["dupont_audit"] = f"""{TO_RATIOS}
select count(dupont_roe_check) as n_checked,
       coalesce(max(abs(dupont_roe_check - roe)) < 1e-6, true) as dupont_ok
from ratios where form = '10-K'"""
ORACLE["red_flags"] = f"""{TO_FLAGS}
select ticker, {text('period_end')}, rule_id, severity from flags where form = '10-K'"""
ORACLE["red_flag_metrics"] = f"""{TO_RATIOS} """ + " union all ".join(
    f"select ticker, {text('period_end')}, '{rule}' as rule_id, '{m}' as metric, {m} as value "
    f"from ratios where form = '10-K' and {cond}"
    for rule, cond, _, metrics in _RULES for m in metrics)
ORACLE["flag_heatmap"] = f"""{TO_FLAGS},
years as (select distinct ticker, 'FY' || year(period_end) as fy from ratios where form = '10-K'),
cells as (select ticker, severity, 'FY' || year(period_end) as fy, count(*) as n
          from flags where form = '10-K' group by all)
select s.ticker, s.severity, y.fy, cast(c.n as double) as n_flags
from (select distinct ticker, severity from cells) s
join years y on y.ticker = s.ticker
left join cells c on c.ticker = s.ticker and c.severity = s.severity and c.fy = y.fy"""
