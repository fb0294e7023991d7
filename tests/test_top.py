"""The first n rows per key, where one key holds most rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.prices import recent_prices
from tallyforge.operators.top import top_per_key


@pytest.mark.parametrize("n, parts", [(1260, 64), (7, 3), (1, 1)])
def test_equals_a_sort_per_key(spark, n, parts):
    rng = random.Random(n)
    rows = [("hot" if i % 4 else f"k{i % 9}", rng.randint(0, 400), None if i % 50 == 0 else i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(5)
    got = top_per_key(df, ["k"], [F.desc("v"), F.asc_nulls_last("i")], n, "rank", ["i"], parts)
    want = {}
    for k, v, i in sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or 0)):
        want.setdefault(k, []).append((v, i))
    mine = {}
    for r in sorted(got.collect(), key=lambda r: (r.k, r["rank"])):
        assert r["rank"] == len(mine.setdefault(r.k, [])) + 1
        mine[r.k].append((r.v, r.i))
    assert {k: [v for v, _ in x] for k, x in mine.items()} == {k: [v for v, _ in x[:n]] for k, x in want.items()}
    assert got.columns == ["k", "v", "i", "rank"]


def test_quotes_of_a_hot_ticker_are_dealt(spark):
    quotes = spark.createDataFrame([("HOT", "2026-01-01", 1.0)], "ticker string, date string, close double")
    plan = recent_prices(quotes)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(exchanges) == 2 and "rank_from_newest_part" not in exchanges[0] and "rank_from_newest_part" in exchanges[1]
