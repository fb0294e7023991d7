"""Registration of queries and of the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def checked(sql: str) -> Callable[[Query], Query]:
    """Register a query together with its SQL."""
    def register(fn: Query) -> Query:
        ORACLE[fn.__name__] = sql
        return query(fn)
    return register


def iso(df: DataFrame) -> DataFrame:
    """Dates as ISO text, the form in which results are compared and served."""
    return df.select(*[F.col(f.name).cast("string") if f.dataType.typeName() == "date"
                       else F.col(f.name) for f in df.schema.fields])
