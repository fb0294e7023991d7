"""Vectors as packed rows: shared by the searches over ``embeddings``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with an id whose vector is not null and holds no null, NaN or infinite component."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).filter(~F.coalesce(bad, F.lit(True)))


def matrix(column: pa.Array, dtype: str = "<f8") -> np.ndarray:
    """Binary rows of equal length as a matrix."""
    raw = column.to_pylist()
    width = len(raw[0]) // np.dtype(dtype).itemsize if raw else 0
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), width)


def packed(rows: DataFrame, width: int, scale: float | None = None, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vector as little-endian numbers, shorter ones filled with zeros.

    Doubles as given, or with ``scale`` the integers floor(scale * x).
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.zeros(width)
                x[:len(v)] = v
                out.append((np.floor(scale * x).astype("<i8") if scale else x.astype("<f8")).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return rows.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>")).mapInArrow(
        pack, "vec_id long, v binary")


def width_of(rows: DataFrame, column: str = "embedding") -> int:
    return int(rows.agg(F.max(F.size(column))).first()[0] or 0)
