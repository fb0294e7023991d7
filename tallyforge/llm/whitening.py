"""Whitening of vectors by spectrum slicing of their exact covariance.

Entries become integers, so counts, sums and products of whole centred numbers
are exact whatever the order of the rows: every task sums the products of its
rows (centred at the whole number nearest to the mean), Spark adds them up, and
the driver sees one number per pair of dimensions.

The leading eigenvalues of that matrix are found one by one.  The signs of
LDLᵀ pivots of the shifted covariance count the eigenvalues above a shift;
bisection by these counts isolates each, Rayleigh quotient iteration finishes
it, and counts on both sides prove its number.  Eigenvalues that counts cannot
tell apart in double precision share an interval, and any orthonormal vectors of
their space are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import stage, table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Products of whole numbers are summed as doubles while they stay exact.
EXACT = 1 << 53
ROWS_AT_ONCE = 1 << 14
OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
       "identity_error double")


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """floor(1024 c) + 100000 of every entry, c as a double; shorter vectors end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(np.asarray(lists.offsets))
    c = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), size)
    c[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    x = np.floor(c * SCALE)
    if len(x) and np.abs(x).max() > 2.0 ** 62:
        raise OverflowError("an entry is too large for a whole number of 64 bits")
    return x.astype(np.int64) + SHIFT


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null and holds finite numbers only; ids do not matter."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter(F.col("embedding").isNotNull()).filter(~F.coalesce(bad, F.lit(False)))


def products(z: np.ndarray) -> np.ndarray:
    """zᵀz of whole numbers as Python integers, exact."""
    largest = int(np.abs(z).max(initial=0))
    rows = min(len(z), EXACT // max(1, largest * largest))
    total = np.zeros((z.shape[1], z.shape[1]), object)
    if not rows:
        part = z.astype(object)
        return part.T @ part if len(z) else total
    for low in range(0, len(z), rows):
        part = z[low:low + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _summed(rows: DataFrame, width: int, numbers: Callable[[np.ndarray], np.ndarray]) -> list[list[int]]:
    """Sums over all rows of the integer matrices that ``numbers`` makes of some rows; one per task is shuffled."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = numbers(whole_numbers(batch.column(0).slice(low, ROWS_AT_ONCE), width))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.nonzero(np.ones(total.shape, bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                 pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0))], names=["i", "j", "s"])

    sums = (rows.select("embedding").mapInArrow(partial, "i int, j int, s decimal(38,0)")
            .groupBy("i", "j").agg(F.sum("s").alias("s")).collect())
    shape = (max((r["i"] for r in sums), default=-1) + 1, max((r["j"] for r in sums), default=-1) + 1)
    out = [[0] * shape[1] for _ in range(shape[0])]
    for r in sums:
        out[r["i"]][r["j"]] = int(r["s"])
    return out


def moments(rows: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sums per dimension, covariance (divisor n) correctly rounded."""
    first = _summed(rows, width, lambda x: np.vstack([x.astype(object).sum(0), np.full(width, len(x), object)]))
    if not first:
        return 0, [], np.zeros((0, 0))
    sums, n = first[0], first[1][0]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    middle = np.array(centre, np.int64)
    squares = _summed(rows, width, lambda x: products(x - middle))
    rest = [s - n * m for s, m in zip(sums, centre)]
    # Python divides whole numbers of any size with one rounding.
    v = np.array([[(n * squares[i][j] - rest[i] * rest[j]) / (n * n) for j in range(width)] for i in range(width)])
    return n, sums, v


# ---- spectrum slicing --------------------------------------------------------------

def count_above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of LDLᵀ of v - shift I, by Sylvester's law of inertia.

    Symmetric pivoting with blocks of one or two (Bunch and Kaufman's partial pivoting).
    """
    a = v - shift * np.eye(len(v))
    tiny = np.finfo(float).eps * max(np.abs(v).max(initial=0.0), np.finfo(float).tiny)
    alpha = (1 + 17 ** 0.5) / 8
    positive = 0
    while len(a):
        below = np.abs(a[1:, 0])
        r = int(below.argmax()) + 1 if len(below) else 0
        largest = below.max(initial=0.0)
        size, swap = 1, 0
        if abs(a[0, 0]) < alpha * largest:
            column = np.abs(a[:, r]).copy()
            column[r] = 0.0
            sigma = column.max()
            if abs(a[0, 0]) * sigma < alpha * largest * largest:
                size, swap = (1, r) if abs(a[r, r]) >= alpha * sigma else (2, r)
        at = size - 1
        if swap != at:
            a[[at, swap]] = a[[swap, at]]
            a[:, [at, swap]] = a[:, [swap, at]]
        if size == 1:
            pivot = a[0, 0] if abs(a[0, 0]) > tiny else -tiny
            positive += pivot > 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:] / pivot)
        else:
            # A block of two is chosen only where its determinant is negative: one eigenvalue on each side.
            positive += 1
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
    return positive


def _start(k: int, size: int) -> np.ndarray:
    return np.random.default_rng(k).standard_normal(size)


def _rayleigh(v: np.ndarray, shift: float, k: int, found: list[np.ndarray], scale: float) -> tuple[float, np.ndarray]:
    """An eigenpair near ``shift``, at right angles to the vectors found before."""
    basis = np.array(found) if found else np.zeros((0, len(v)))
    eye = np.eye(len(v))

    def free(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - basis.T @ (basis @ x)
        return x / np.linalg.norm(x)

    def solved(x: np.ndarray, at: float) -> np.ndarray:
        for nudge in (0.0, 4.0, 64.0):
            try:
                y = np.linalg.solve(v - (at + nudge * np.finfo(float).eps * scale) * eye, x)
                if np.isfinite(y).all() and y.any():
                    return free(y / np.abs(y).max())
            except np.linalg.LinAlgError:
                pass
        return x

    x = free(_start(k, len(v)))
    for _ in range(3):
        x = solved(x, shift)
    rho, worse = float(x @ v @ x), np.inf
    for _ in range(20):
        residual = np.linalg.norm(v @ x - rho * x)
        if residual >= worse:
            break
        worse = residual
        following = solved(x, rho)
        value = float(following @ v @ following)
        if np.linalg.norm(v @ following - value * following) > residual:
            break
        x, rho = following, value
    return rho, x


def leading(v: np.ndarray, k: int) -> list[tuple[float, np.ndarray, float, float]]:
    """The k largest eigenvalues in falling order, each as (value, unit vector, low, high).

    Counts certify that the value is the only one between low and high, or that
    values whose intervals are the same cannot be told apart.  Values that are
    not above rounding are left out.
    """
    size = len(v)
    scale = float(np.abs(v).sum(1).max(initial=0.0))
    floor = np.finfo(float).eps * size * max(float(np.trace(v)), 0.0) if size else 0.0
    out: list[tuple[float, np.ndarray, float, float]] = []
    vectors: list[np.ndarray] = []
    width = 8 * np.finfo(float).eps * scale
    top = scale * (1 + 1e-12) + np.finfo(float).tiny
    known: dict[float, int] = {top: 0}

    def above(shift: float) -> int:
        if shift not in known:
            known[shift] = count_above(v, shift)
        return known[shift]

    while len(out) < min(k, size) and above(floor) > len(out):
        wanted = len(out) + 1
        # The nearest shifts known so far that enclose the wanted eigenvalue.
        low = max((s for s, c in known.items() if c >= wanted), default=floor)
        high = min((s for s, c in known.items() if c < wanted and s > low), default=top)
        while high - low > width:
            if above(low) == wanted and above(high) == wanted - 1:
                value, vector = _rayleigh(v, (low + high) / 2, wanted, vectors, scale)
                if low < value <= high:
                    break
            middle = (low + high) / 2
            if above(middle) >= wanted:
                low = middle
            else:
                high = middle
        else:
            # A cluster: as many vectors as the counts say.
            for _ in range(min(above(low), k) - len(out)):
                value, vector = _rayleigh(v, (low + high) / 2, len(out) + 1, vectors, scale)
                vectors.append(vector)
                out.append((value, vector, low, high))
            continue
        # The counts next to the value itself prove its number.
        slack = max(width, 4 * float(np.linalg.norm(v @ vector - value * vector)))
        inner = (max(low, value - slack), min(high, value + slack))
        if above(inner[0]) >= wanted and above(inner[1]) < wanted:
            low, high = inner
        vectors.append(vector)
        out.append((value, vector, low, high))
    return out


# ---- the operator ------------------------------------------------------------------

def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and leading component: the columns of ``OUT``.

    Vectors that are null or hold null or non-finite entries are dropped; a
    null or repeated vec_id, and equal vectors, stay rows of their own; shorter
    vectors count as ending in zeros.  A component without variance (one vector
    only, constant dimensions) has no whitened value and no rows; an empty table
    gives none.  A deviation beyond 64 bits is null.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    width = int(rows.agg(F.max(F.size("embedding"))).first()[0] or 0)
    n, sums, v = moments(rows, width) if width else (0, [], np.zeros((0, 0)))
    pairs = leading(v, components)
    if not pairs:
        return spark.createDataFrame([], OUT)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, centre)], np.int64)
    turned = np.array([vector / value ** 0.5 for value, vector, _, _ in pairs]).T

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                z = whole_numbers(batch.column(1).slice(low, ROWS_AT_ONCE), width) - centre
                w = (z - rest / n) @ turned
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, ROWS_AT_ONCE), pa.array(_deviations(z, n, rest), pa.int64()),
                     pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))],
                    names=["vec_id", "deviation", "w"])

    # Written once: the covariance of what is returned is measured on it.
    done = stage(rows.select("vec_id", "embedding").mapInArrow(project, "vec_id long, deviation long, w array<double>"))
    error = identity_error(done, len(pairs))
    total = float(np.trace(v))
    share = F.array(*[F.lit(value / total) for value, _, _, _ in pairs])
    return (done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                    "deviation", "whitened", F.get(share, F.col("at")).alias("explained"),
                    F.lit(error).alias("identity_error")))


def _deviations(z: np.ndarray, n: int, rest: np.ndarray) -> list[int | None] | np.ndarray:
    """Exact sums over dimensions of (n x - S)^2."""
    largest = n * int(np.abs(z).max(initial=0)) + int(np.abs(rest).max(initial=0))
    if largest * largest * z.shape[1] < 1 << 63:
        return ((n * z - rest) ** 2).sum(1)
    exact = ((n * z.astype(object) - rest.astype(object)) ** 2).sum(1)
    return [int(e) if e < 1 << 63 else None for e in exact]


def identity_error(done: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of the array ``w``, less the identity."""
    at = [F.get("w", F.lit(i)) for i in range(k)]
    means = done.agg(*[F.avg(c) for c in at]).first()
    places = [(i, j) for i in range(k) for j in range(i + 1)]
    row = done.agg(*[F.avg((at[i] - F.lit(means[i])) * (at[j] - F.lit(means[j]))) for i, j in places]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(row, places))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
