import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tallyforge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, shuffle_partitions=4, memory="6g")


# The planted company, in millions.
MILLION = 1_000_000.0
FIELDS = ("revenue", "cost", "operating", "net", "assets", "current_assets",
          "current_liabilities", "equity", "receivables", "inventory", "ocf", "cash")
TAG_OF = {
    "revenue": "Revenues", "cost": "CostOfGoodsAndServicesSold",
    "operating": "OperatingIncomeLoss", "net": "NetIncomeLoss", "assets": "Assets",
    "current_assets": "AssetsCurrent", "current_liabilities": "LiabilitiesCurrent",
    "equity": "StockholdersEquity", "receivables": "AccountsReceivableNetCurrent",
    "inventory": "InventoryNet", "ocf": "NetCashProvidedByUsedInOperatingActivities",
    "cash": "CashAndCashEquivalentsAtCarryingValue",
}
DURATIONS = {"revenue", "cost", "operating", "net", "ocf"}
PLANTED = {
    2023: (1000, 600, 200, 150, 2000, 800, 500, 900, 100, 120, 180, 300),
    2024: (1100, 660, 220, 165, 2200, 880, 550, 990, 110, 132, 200, 300),
    2025: (1210, 726, 242, 181, 2420, 968, 605, 1089, 165, 145, 72, 300),
}


def fact(ticker, tag, year, value, *, duration=True, form="10-K", filed=None, accn=None,
         fy=None, start=None, end=None, unit="USD", taxonomy="us-gaap"):
    end = end or f"{year}-12-31"
    return {"ticker": ticker, "taxonomy": taxonomy, "tag": tag, "label": tag, "unit": unit,
            "period_start": (start or f"{year - 1}-12-31") if duration else None,
            "period_end": end, "val": None if value is None else value * MILLION,
            "fy": fy or year, "fp": "FY", "form": form, "filed": filed or f"{year + 1}-02-15",
            "frame": None, "accn": accn or f"acc-{ticker}-{year}"}


def company(ticker="TEST", years=PLANTED):
    rows = []
    for year, values in years.items():
        for name, value in zip(FIELDS, values):
            if value is not None:
                rows.append(fact(ticker, TAG_OF[name], year, value, duration=name in DURATIONS))
    return rows


def planted_facts():
    """The planted company with its restated 2023 revenue."""
    return company() + [fact("TEST", "Revenues", 2023, 1005, filed="2026-02-15",
                             accn="acc-restated", fy=2025)]


def facts_df(spark, rows):
    from tallyforge.schemas import FACTS
    from pyspark.sql import functions as F
    text = FACTS.replace("DATE", "STRING")
    names = [f.split()[0] for f in text.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], text)
    return df.withColumns({c: F.col(c).cast("date") for c in ("period_start", "period_end", "filed")})
