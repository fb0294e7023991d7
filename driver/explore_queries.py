"""Explorer tables, industry comparison, prices and the ticker registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import fixtures as fx
from driver.oracle import TO_FLAGS, TO_RATIOS, TO_WIDE, text
from driver.queries import annual_periods, annual_wide
from driver.registry import checked, iso
from tallyforge.operators import documents, flags, income, peers, periods, prices, registry
from tallyforge.operators import statements as stmt_ops
from tallyforge.operators.facts import ANNUAL, QUARTERLY


def both_wide(spark, sf_dir):
    """Annual and quarterly wide rows out of one pass over the facts."""
    tidy = stmt_ops.build_statements(fx.facts(spark, sf_dir), [ANNUAL, QUARTERLY])
    return stmt_ops.to_wide(tidy, ("ticker", "form", "period_end"))


_TICKER = "'S' || lpad(cast({} as varchar), 5, '0')"

# ---- explorer tables ------------------------------------------------------------

RECENT = """recent_k as (
  select * from ratios where form = '10-K'
  qualify date_diff('day', period_end, max(period_end) over (partition by ticker)) <= 1898)"""


@checked(f"""{TO_FLAGS}, {RECENT},
with_n as (select r.*, (select count(*) from flags f where f.form = '10-K' and f.ticker = r.ticker
                         and f.period_end = r.period_end) as n_flags from recent_k r),
k as (select *, (roe - lag(roe) over w) * 100 as roe_change_pp,
             (net_margin - lag(net_margin) over w) * 100 as net_margin_change_pp
      from with_n window w as (partition by ticker order by period_end))
select ticker, {text('period_end')}, revenue, net_income, revenue_growth, net_income_growth, roe,
       roe_change_pp, net_margin, net_margin_change_pp, n_flags
from k qualify row_number() over (partition by ticker order by period_end desc) = 1""")
def kpi_row(spark, sf_dir):
    return iso(periods.kpi_row(annual_periods(spark, sf_dir)))


@checked(f"""{TO_WIDE}, ends as (
  select ticker, max(period_end) filter (where form = '10-K') as a,
         max(period_end) filter (where form = '10-Q') as q from wide group by ticker)
select ticker, cast(a as varchar) as annual_end, cast(q as varchar) as quarter_end,
       coalesce(q > a, false) as quarter_offered
from ends where a is not null""")
def period_choice(spark, sf_dir):
    return iso(periods.period_choice(both_wide(spark, sf_dir)))


_ITEMS = periods.COMMON_SIZE_ITEMS
_RECENT_BOTH = """recent as (
  select * from wide
  qualify date_diff('day', period_end, max(period_end) over (partition by ticker, form))
          <= case when form = '10-K' then 1898 else 839 end),
pos as (select *, row_number() over (partition by ticker, form order by period_end desc) as rn from recent)"""


def _line(item: str, name: str, yoy: str, qoq: str, source: str) -> str:
    return (f"select ticker, {text('period_end')}, rn = 1 as is_newest, '{name}' as line_item, "
            f"{item} as value, {item} / nullif(revenue, 0) as share_of_revenue, "
            f"({item} - {yoy}) / nullif(abs({yoy}), 0) as yoy, {qoq} as qoq "
            f"from {source} where {item} is not null")


@checked(TO_WIDE.replace("recent as", "recent_p as").replace("from recent\n", "from recent_p\n")
         + f", {_RECENT_BOTH}, k as (select *, "
         + ", ".join(f"lag({i}) over w as y_{i}" for i in _ITEMS)
         + " from pos where form = '10-K' window w as (partition by ticker order by period_end)),"
         + " quarters as (select ticker, "
         + ", ".join(f"max({i}) filter (where rn = {n}) as q{n}_{i}" for i in _ITEMS for n in (1, 2))
         + " from pos where form = '10-Q' group by ticker),"
         + " j as (select k.*, q.* exclude (ticker) from k left join quarters q on q.ticker = k.ticker) "
         + " union all ".join(
             _line(i, n, f"y_{i}",
                   f"case when rn = 1 then (q1_{i} - q2_{i}) / nullif(abs(q2_{i}), 0) end", "j")
             for i, n in _ITEMS.items()))
def common_size_annual(spark, sf_dir):
    return iso(periods.common_size(both_wide(spark, sf_dir)))


@checked(TO_WIDE.replace("recent as", "recent_p as").replace("from recent\n", "from recent_p\n")
         + f", {_RECENT_BOTH}, j as (select *, "
         + ", ".join(f"lag({i}, {n}) over w as l{n}_{i}" for i in _ITEMS for n in (1, 4))
         + " from pos where form = '10-Q' window w as (partition by ticker order by period_end)) "
         + " union all ".join(
             _line(i, n, f"l4_{i}", f"({i} - l1_{i}) / nullif(abs(l1_{i}), 0)", "j")
             for i, n in _ITEMS.items()))
def common_size_quarterly(spark, sf_dir):
    return iso(periods.common_size(both_wide(spark, sf_dir), quarterly=True))


def _trend_part(family: str, metric: str, expression: str) -> str:
    shown = ("max(dso_days is not null or dio_days is not null) over (partition by ticker)"
             if family == "Cash cycle" else f"max({metric} is not null) over (partition by ticker)")
    return (f"select ticker, {text('period_end')}, 'FY' || year(period_end) as fy, '{family}' as family, "
            f"'{metric}' as metric, {expression} as value from recent_k qualify {shown}")


@checked(f"{TO_RATIOS}, {RECENT} "
         + " union all ".join(_trend_part(*part) for part in periods.TREND_FAMILIES))
def trend_series(spark, sf_dir):
    return iso(periods.trend_series(annual_periods(spark, sf_dir)))


_FLOW = """n as (select ticker, period_end, revenue rev, net_income ni, cost_of_revenue cogs, gross_profit gp,
  operating_income oi, pretax_income pti, income_tax_expense tax, compensation_expense comp,
  rd_expense rd, sga_expense sga, operating_expenses ox,
  coalesce(cost_of_revenue > 0 and gross_profit > 0 and operating_income > 0, false) std,
  coalesce(pretax_income > 0 and pretax_income <= revenue and income_tax_expense >= 0, false) fin
  from wide where form = '10-K' and revenue > 0 and net_income > 0),
f as (select *, gp - oi as x,
  case when ox is not null and abs(ox - (rev - pti)) < rev * 0.15::double then ox else rev - pti end as y,
  std and coalesce(pti > 0 and tax >= 0, false) as taxed
  from n where std or fin),
g as (select *, case when rd > 0 and rd <= x * 1.02::double then rd else 0 end as rdk from f),
h as (select *, case when sga > 0 and rdk + sga <= x * 1.02::double then sga else 0 end as sgak from g)"""
_EDGES = [
    ("std", "Revenue", "Gross profit", "gp"), ("std", "Revenue", "Cost of revenue", "cogs"),
    ("std", "Gross profit", "Operating income", "oi"),
    ("std", "Gross profit", "Operating expenses", "x"),
    ("std and rdk > 0", "Operating expenses", "R&D", "rd"),
    ("std and sgak > 0", "Operating expenses", "SG&A", "sga"),
    ("std and rdk + sgak > 0 and x - (rdk + sgak) > x * 0.02::double", "Operating expenses",
     "Other opex", "x - (rdk + sgak)"),
    ("taxed and pti >= oi", "Operating income", "Pre-tax income", "oi"),
    ("taxed and pti >= oi", "Non-operating income", "Pre-tax income", "pti - oi"),
    ("taxed and pti < oi", "Operating income", "Pre-tax income", "pti"),
    ("taxed and pti < oi", "Operating income", "Non-operating costs", "oi - pti"),
    ("std and not taxed", "Operating income", "Net income", "least(ni, oi)"),
    ("not std", "Revenue", "Pre-tax income", "pti"),
    ("not std", "Revenue", "Operating expenses", "y"),
    ("not std and comp > 0 and comp <= y", "Operating expenses", "Compensation & benefits", "comp"),
    ("not std and comp > 0 and comp <= y and y - comp > y * 0.02::double", "Operating expenses",
     "Other expenses", "y - comp"),
    ("taxed or not std", "Pre-tax income", "Net income", "ni"),
    ("taxed or not std", "Pre-tax income", "Income tax", "tax"),
]


@checked(f"{TO_WIDE}, {_FLOW} " + " union all ".join(
    f"select ticker, {text('period_end')}, '{s}' as source, '{t}' as target, "
    f"greatest({v}, 1e-9::double) as value from h where {c}" for c, s, t, v in _EDGES))
def income_flow_edges(spark, sf_dir):
    return iso(income.income_flow_edges(annual_wide(spark, sf_dir)))


@checked(f"""{TO_WIDE}, {_FLOW},
newest as (select * from f qualify period_end = (select max(w.period_end) from wide w
            where w.form = '10-K' and w.ticker = f.ticker)),
seg as (select {_TICKER.format('l_suppkey')} as ticker, 'Line ' || l_returnflag as label,
               cast(floor(min(l_extendedprice) * 10) as double) as value from lineitem group by 1, 2),
tot as (select ticker, sum(value) as total from seg group by ticker),
shown as (select n.ticker, n.period_end, n.rev, t.total from newest n join tot t on t.ticker = n.ticker
          where t.total <= n.rev * 1.05::double)
select s.ticker, {text('period_end').replace('cast(', 'cast(s.')}, g.label as source,
       'Revenue' as target, greatest(g.value, 1e-9::double) as value
from shown s join seg g on g.ticker = s.ticker
union all
select ticker, {text('period_end')}, 'Other', 'Revenue', greatest(rev - total, 1e-9::double)
from shown where total < rev * 0.98::double""".replace("qualify period_end =", "where period_end ="))
def income_segment_edges(spark, sf_dir):
    newest = periods.latest_row(annual_wide(spark, sf_dir))
    return iso(income.segment_edges(newest, fx.segments(spark, sf_dir)))


_ANNUAL_ONLY = "from wide where form = '10-K' and"
_BRIDGE = f"""{TO_WIDE}, s as (select *,
  cost_of_revenue is not null and gross_profit is not null and operating_income is not null as full_shape,
  case when operating_expenses is not null and abs(operating_expenses - (revenue - pretax_income))
            < abs(revenue) * 0.15::double then operating_expenses else revenue - pretax_income end as y
  from wide where form = '10-K' and revenue is not null and net_income is not null),
steps as (
  select *, [{{'l': 'Revenue', 'v': revenue, 'm': 'absolute'}}]
    || case when full_shape then [{{'l': 'Cost of revenue', 'v': -cost_of_revenue, 'm': 'relative'}},
                                  {{'l': 'Operating expenses', 'v': -(gross_profit - operating_income), 'm': 'relative'}}] else [] end
    || case when full_shape and pretax_income is not null
            then [{{'l': 'Non-operating, net', 'v': pretax_income - operating_income, 'm': 'relative'}}] else [] end
    || case when not full_shape and pretax_income is not null
            then [{{'l': 'Operating expenses', 'v': -y, 'm': 'relative'}}] else [] end
    || case when not full_shape and pretax_income is null
            then [{{'l': 'Operating expenses', 'v': -operating_expenses, 'm': 'relative'}}] else [] end
    || case when income_tax_expense is not null then [{{'l': 'Income tax', 'v': -income_tax_expense, 'm': 'relative'}}] else [] end
    || [{{'l': 'Net income', 'v': net_income, 'm': 'total'}}] as list
  from s where full_shape or pretax_income is not null or operating_expenses is not null),
flat as (select ticker, period_end, generate_subscripts(list, 1) as step_no, unnest(list) as st from steps)
select ticker, {text('period_end')}, cast(step_no as bigint) as step_no, st.l as label, st.v as value,
       st.m as measure from flat"""


@checked(_BRIDGE)
def income_bridge_steps(spark, sf_dir):
    return iso(income.income_bridge_steps(annual_wide(spark, sf_dir)))


_CHOSEN = """ends_o as (select ticker, max(period_end) filter (where form = '10-K') as a,
                max(period_end) filter (where form = '10-Q') as q from wide group by ticker),
offered as (select w.* from wide w join ends_o e on e.ticker = w.ticker where e.a is not null
           and w.form = case when e.q > e.a then '10-Q' else '10-K' end
           and w.period_end = case when e.q > e.a then e.q else e.a end)"""


@checked(f"{TO_WIDE}, {_CHOSEN}, {_FLOW.replace(_ANNUAL_ONLY, 'from offered where')} " + " union all ".join(
    f"select ticker, {text('period_end')}, '{s}' as source, '{t}' as target, "
    f"greatest({v}, 1e-9::double) as value from h where {c}" for c, s, t, v in _EDGES))
def income_flow_latest(spark, sf_dir):
    """The flow of the period that the explorer offers first."""
    return iso(income.income_flow_edges(periods.chosen_period(both_wide(spark, sf_dir))))


@checked(_BRIDGE.replace(_ANNUAL_ONLY, "from offered where").replace(", s as (", f", {_CHOSEN}, s as (", 1))
def income_bridge_latest(spark, sf_dir):
    return iso(income.income_bridge_steps(periods.chosen_period(both_wide(spark, sf_dir))))


_VISIBLE = f"""{TO_FLAGS}, shown as (
  select ticker, period_end from ratios where form = '10-K'
  qualify date_diff('day', period_end, max(period_end) over (partition by ticker)) <= 1898)
select f.ticker, cast(f.period_end as varchar) as period_end, rule_id, severity,
       'FY' || year(f.period_end) as fy, case severity when 'high' then 1 when 'medium' then 2 else 3 end as severity_rank
from flags f semi join shown s on s.ticker = f.ticker and s.period_end = f.period_end
where f.form = '10-K'"""


def _listed(shown):
    return iso(shown.select(
        "ticker", "period_end", "rule_id", "severity",
        F.concat(F.lit("FY"), F.year("period_end").cast("string")).alias("fy"),
        flags.severity_rank(F.col("severity")).cast("int").alias("severity_rank")))


@checked(_VISIBLE)
def flags_visible(spark, sf_dir):
    """Flags of the visible periods, raised on the visible rows only."""
    shown = periods.recent_periods(annual_periods(spark, sf_dir))
    return _listed(flags.sorted_flags(flags.red_flags(shown)))


@checked(_VISIBLE)
def flags_visible_tables(spark, sf_dir):
    """The same from separate flag and period tables."""
    rows = annual_periods(spark, sf_dir)
    return _listed(flags.visible_flags(flags.red_flags(rows), periods.recent_periods(rows)))


# ---- industry -------------------------------------------------------------------

_COMPANIES = f"""co as (select {_TICKER.format('s_suppkey')} as ticker, s_suppkey as cik, s_name as entity_name,
  lpad(cast(s_nationkey as varchar), 4, '0') as sic, s_acctbal as market_cap from supplier)"""
_LATEST = """latest_r as (select ticker, revenue, net_margin, roe, debt_to_equity from ratios where form = '10-K'
  qualify row_number() over (partition by ticker order by period_end desc) = 1)"""


@checked(f"""{TO_RATIOS}, {_COMPANIES}, {_LATEST}
select sic, co.ticker, entity_name, revenue, net_margin, roe, debt_to_equity
from co left join latest_r l on l.ticker = co.ticker""")
def industry_table(spark, sf_dir):
    return peers.industry_table(fx.companies(spark, sf_dir),
                                peers.latest_metrics(annual_periods(spark, sf_dir)))


@checked(f"""{TO_RATIOS}, {_COMPANIES}, {_LATEST},
subj as (select sic, ticker as subject from co
         qualify row_number() over (partition by sic order by market_cap desc, ticker) = 1)
select subject, cast(case when co.ticker = subject then 0 else 1 end as bigint) as peer_order,
       co.sic, co.ticker, entity_name, revenue, net_margin, roe, debt_to_equity
from co join subj s on s.sic = co.sic left join latest_r l on l.ticker = co.ticker""")
def peer_comparison(spark, sf_dir):
    """The largest company of each industry against its peers."""
    companies = fx.companies(spark, sf_dir)
    roster = companies.select("sic", F.col("entity_name").alias("company"), "cik", "market_cap")
    subjects = peers.industry_leaders(roster, companies, companies, n=1) \
        .select("sic", F.col("ticker").alias("subject"))
    return peers.peer_comparison(subjects, companies,
                                 peers.latest_metrics(annual_periods(spark, sf_dir)))


@checked(f"""with {_COMPANIES},
cat as (select distinct {_TICKER.format('l_suppkey')} as ticker from lineitem where l_returnflag = 'R'),
top as (select sic, row_number() over (partition by sic order by market_cap desc, ticker) as rank,
               entity_name as company, ticker, market_cap from co qualify rank <= 5)
select sic, rank, company, top.ticker, market_cap,
       exists (select 1 from cat where cat.ticker = top.ticker) as in_catalog from top""")
def industry_leaders(spark, sf_dir):
    companies = fx.companies(spark, sf_dir)
    roster = companies.select("sic", F.col("entity_name").alias("company"), "cik", "market_cap")
    ingested = fx.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R") \
        .select(fx.ticker_of(F.col("l_suppkey")).alias("ticker"))
    return peers.industry_leaders(roster, companies, ingested)


# ---- registry -------------------------------------------------------------------

_ASKED = """asked as (select distinct upper(trim(case when c_acctbal < 0 then 's-' || cast(c_custkey as varchar)
  else ' s' || lpad(cast(c_custkey as varchar), 5, '0') || ' ' end)) as ticker from customer),
known as (select 'S' || lpad(cast(s_suppkey as varchar), 5, '0') as ticker, s_suppkey as cik, s_name as title,
                 s_nationkey from supplier),
have as (select ticker from known k join nation n on n.n_nationkey = k.s_nationkey
         join region r on r.r_regionkey = n.n_regionkey where r_name = 'ASIA')"""


def _ingested(spark, sf_dir):
    """Companies of one region are taken as ingested."""
    nations = fx.table(spark, sf_dir, "nation").join(
        fx.table(spark, sf_dir, "region").filter(F.col("r_name") == "ASIA"),
        F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return (fx.table(spark, sf_dir, "supplier")
            .join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
            .select(fx.ticker_of(F.col("s_suppkey")).alias("ticker")))


def _registry(spark, sf_dir):
    return fx.companies(spark, sf_dir).select(
        F.col("cik").alias("pos"), "cik", "ticker", F.col("entity_name").alias("title"))


@checked(f"""with {_ASKED} select a.ticker, cast(k.cik as double) as cik, k.title
from (select upper(trim(case when c_acctbal < 0 then 's-' || cast(c_custkey as varchar)
  else ' s' || lpad(cast(c_custkey as varchar), 5, '0') || ' ' end)) as ticker from customer) a
left join known k on k.ticker = a.ticker""")
def ticker_lookup(spark, sf_dir):
    found = registry.lookup_tickers(fx.requests(spark, sf_dir), _registry(spark, sf_dir))
    return found.select("ticker", F.col("cik").cast("double").alias("cik"), "title")


@checked(f"""with {_ASKED} select ticker, case
  when not regexp_full_match(ticker, '[A-Z0-9]+') then 'invalid'
  when ticker in (select ticker from have) then 'already_available'
  when ticker not in (select ticker from known) then 'unknown' else 'accepted' end as status
from asked""")
def ticker_validation(spark, sf_dir):
    return registry.validate_tickers(fx.requests(spark, sf_dir), _registry(spark, sf_dir),
                                     _ingested(spark, sf_dir))


@checked(f"""with {_ASKED} select ticker from asked union select ticker from have""")
def work_list(spark, sf_dir):
    asked = fx.requests(spark, sf_dir).select(F.upper(F.trim("ticker")).alias("ticker"))
    return registry.work_list(asked, _ingested(spark, sf_dir))


@checked(f"""with {_ASKED}, work as (select ticker from asked union select ticker from have)
select ticker, ticker in (select ticker from asked) as requested
from work where ticker not in (select ticker from known)""")
def failure_report(spark, sf_dir):
    asked = fx.requests(spark, sf_dir).select(F.upper(F.trim("ticker")).alias("ticker"))
    work = registry.work_list(asked, _ingested(spark, sf_dir))
    return registry.failure_report(work, fx.companies(spark, sf_dir), asked)


@checked("""with k as (select upper(trim(unnest(string_split(c_mktsegment || ', ' || c_name || ',,', ','))))
  as ticker from customer) select distinct ticker from k where ticker <> ''""")
def requested_keys(spark, sf_dir):
    lists = fx.table(spark, sf_dir, "customer").select(
        F.concat("c_mktsegment", F.lit(", "), "c_name", F.lit(",,")).alias("names"))
    return registry.requested_keys(lists, "names")


# ---- filings and prices -----------------------------------------------------------

@checked(f"""select {_TICKER.format('o_custkey')} as ticker, lpad(cast(o_orderkey as varchar), 12, '0') as accession_number,
cast(cast(o_orderdate as date) as varchar) as filing_date,
cast(row_number() over (partition by o_custkey order by cast(o_orderdate as date) desc, o_orderkey desc) as bigint) as filing_rank
from orders where o_orderstatus = 'F' qualify filing_rank <= 2""")
def recent_filings(spark, sf_dir):
    # By the number: of customers above 99,999 several share a ticker.
    newest = documents.recent_filings(fx.filings(spark, sf_dir), key="cik")
    return iso(newest.select("ticker", "accession_number", "filing_date",
                             F.col("filing_rank").cast("bigint").alias("filing_rank")))


_PRICES = """px as (select o_orderpriority as ticker, cast(o_orderdate as date) as date,
  arg_max(o_totalprice, o_orderkey) as close from orders group by 1, 2),
kept as (select *, row_number() over (partition by ticker order by date desc) as rn from px qualify rn <= 1260)"""


@checked(f"with {_PRICES} select ticker, cast(date as varchar) as date, close from kept")
def price_recent(spark, sf_dir):
    return iso(prices.recent_prices(fx.prices(spark, sf_dir)).select("ticker", "date", "close"))


@checked("""with px as (select o_orderpriority as ticker, cast(o_orderdate as date) as date,
  case when o_orderstatus = 'F' then 'first' else 'second' end as source,
  arg_max(o_totalprice, o_orderkey) as close from orders group by 1, 2, 3),
enough as (select ticker from px where source = 'first' group by ticker having count(*) > 10)
select ticker, cast(date as varchar) as date, source, close from px
where source = case when ticker in (select ticker from enough) then 'first' else 'second' end""")
def price_source(spark, sf_dir):
    source = F.when(F.col("o_orderstatus") == "F", "first").otherwise("second")
    quotes = (fx.table(spark, sf_dir, "orders")
              .groupBy(F.col("o_orderpriority").alias("ticker"),
                       F.col("o_orderdate").cast("date").alias("date"), source.alias("source"))
              .agg(F.max_by("o_totalprice", "o_orderkey").alias("close")))
    return iso(prices.choose_source(quotes, "first", "second")
               .select("ticker", "date", "source", "close"))


@checked(f"""with {_PRICES},
y as (select *, date_diff('day', date, max(date) over (partition by ticker)) <= 365 as year from kept),
sh as (select o_orderpriority as ticker, cast(o_custkey as double) as shares from orders
  qualify row_number() over (partition by o_orderpriority order by cast(o_orderdate as date) desc, o_orderkey desc) = 1),
card as (select ticker, max(close) filter (where rn = 1) as last_close, max(close) filter (where rn = 2) as prev,
  max(close) filter (where year) as high_52w, min(close) filter (where year) as low_52w from y group by ticker)
select card.ticker, last_close, last_close / nullif(prev, 0) - 1 as day_change, high_52w, low_52w,
       case when shares <> 0 then last_close * shares end as market_cap
from card left join sh on sh.ticker = card.ticker""")
def price_card(spark, sf_dir):
    return prices.price_card(fx.prices(spark, sf_dir),
                             prices.latest_shares(fx.shares(spark, sf_dir)))
