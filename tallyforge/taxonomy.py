"""Line items and the ordered tags that may report them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Line item | statement | kind | tags in fallback order.
# IS = income statement, BS = balance sheet, CF = cash flow.
_LINE_ITEM_TABLE = """
revenue | IS | duration | RevenueFromContractWithCustomerExcludingAssessedTax RevenuesNetOfInterestExpense Revenues SalesRevenueNet RevenueFromContractWithCustomerIncludingAssessedTax
cost_of_revenue | IS | duration | CostOfGoodsAndServicesSold CostOfRevenue CostOfGoodsSold CostOfServices
gross_profit | IS | duration | GrossProfit
operating_income | IS | duration | OperatingIncomeLoss
rd_expense | IS | duration | ResearchAndDevelopmentExpense ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost
sga_expense | IS | duration | SellingGeneralAndAdministrativeExpense GeneralAndAdministrativeExpense
operating_expenses | IS | duration | NoninterestExpense OperatingExpenses CostsAndExpenses BenefitsLossesAndExpenses
compensation_expense | IS | duration | LaborAndRelatedExpense SalariesWagesAndOfficersCompensation
interest_expense | IS | duration | InterestExpense InterestExpenseNonoperating InterestAndDebtExpense InterestExpenseDebt
pretax_income | IS | duration | IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments
income_tax_expense | IS | duration | IncomeTaxExpenseBenefit
net_income | IS | duration | NetIncomeLoss ProfitLoss NetIncomeLossAvailableToCommonStockholdersBasic
cash_and_equivalents | BS | instant | CashAndCashEquivalentsAtCarryingValue CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents
accounts_receivable | BS | instant | AccountsReceivableNetCurrent ReceivablesNetCurrent AccountsNotesAndLoansReceivableNetCurrent
inventory | BS | instant | InventoryNet InventoryFinishedGoodsNetOfReserves
current_assets | BS | instant | AssetsCurrent
total_assets | BS | instant | Assets
accounts_payable | BS | instant | AccountsPayableCurrent AccountsPayableAndAccruedLiabilitiesCurrent
current_liabilities | BS | instant | LiabilitiesCurrent
short_term_debt | BS | instant | LongTermDebtCurrent DebtCurrent ShortTermBorrowings CommercialPaper
long_term_debt | BS | instant | LongTermDebtNoncurrent LongTermDebt LongTermDebtAndCapitalLeaseObligations
total_liabilities | BS | instant | Liabilities
stockholders_equity | BS | instant | StockholdersEquity StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest
operating_cash_flow | CF | duration | NetCashProvidedByUsedInOperatingActivities NetCashProvidedByUsedInOperatingActivitiesContinuingOperations
capex | CF | duration | PaymentsToAcquirePropertyPlantAndEquipment PaymentsToAcquireProductiveAssets
investing_cash_flow | CF | duration | NetCashProvidedByUsedInInvestingActivities NetCashProvidedByUsedInInvestingActivitiesContinuingOperations
financing_cash_flow | CF | duration | NetCashProvidedByUsedInFinancingActivities NetCashProvidedByUsedInFinancingActivitiesContinuingOperations
depreciation_amortization | CF | duration | DepreciationDepletionAndAmortization DepreciationAmortizationAndAccretionNet Depreciation
"""


def taxonomy_rows() -> list[tuple[int, str, str, str, str, int]]:
    """(tag_id, tag, line_item, statement, kind, tag_rank), one row per tag."""
    rows = []
    for line in _LINE_ITEM_TABLE.strip().splitlines():
        item, statement, kind, tags = (part.strip() for part in line.split("|"))
        for rank, tag in enumerate(tags.split()):
            rows.append((len(rows), tag, item, statement, kind, rank))
    return rows


TAGS = [row[1] for row in taxonomy_rows()]
LINE_ITEMS = list(dict.fromkeys(row[2] for row in taxonomy_rows()))
REVENUE_TAGS = [row[1] for row in taxonomy_rows() if row[2] == "revenue"]


def taxonomy_values() -> str:
    """The taxonomy as the body of a SQL VALUES list."""
    return ", ".join(f"({i}, '{tag}', '{item}', '{st}', '{kind}', {rank})"
                     for i, tag, item, st, kind, rank in taxonomy_rows())


def taxonomy_df(spark: SparkSession) -> DataFrame:
    """64 constant rows; small enough to broadcast at any data size."""
    return spark.sql(f"SELECT * FROM VALUES {taxonomy_values()} "
                     "AS t(tag_id, tag, line_item, statement, kind, tag_rank)")
