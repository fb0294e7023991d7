"""The first n rows per key, also where one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt to.
PARTS = 64


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str,
                deal_by: list[str], parts: int = PARTS) -> DataFrame:
    """The first ``n`` rows of each key in the given order, numbered from 1 in the column ``rank``.

    Spark cuts a ranking before the shuffle up to 1,000 rows only.  Beyond that
    all rows of a key would be sorted by one task, so the rows of a key are
    dealt to parts by the columns ``deal_by`` (null counts as a value), each part
    is cut to ``n`` rows, and at most ``parts * n`` rows per key are ranked at
    last.  The order must be total for the same result in every run.
    """
    part, place = f"{rank}_part", f"{rank}_in_part"
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*deal_by), F.lit(parts)).cast("int"))
    first = Window.partitionBy(*keys, part).orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    cut = dealt.withColumn(place, F.row_number().over(first)).filter(F.col(place) <= n).drop(part, place)
    return cut.withColumn(rank, F.row_number().over(last)).filter(F.col(rank) <= n)
