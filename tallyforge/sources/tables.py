"""Stored tables: scans, counts, type restoration, full and keyed writes."""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyforge.schemas import empty
from tallyforge.session import checkpoint_root

BUCKETS = 256


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets))


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _stored(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame | None:
    """The table at a path; None if it is absent or has never had a row.

    With a schema no file footer is read for planning; without one the schemas
    of all files are merged.
    """
    reader = spark.read.schema(ddl) if ddl else spark.read.option("mergeSchema", True)
    try:
        return reader.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_table(spark: SparkSession, path: str, ddl: str | None = None,
               order_by: list[str] | None = None) -> DataFrame:
    """A stored table; if it is absent, an empty one with the given schema."""
    df = _stored(spark, path, ddl)
    if df is None:
        if ddl is None:
            raise FileNotFoundError(f"No table at {path}")
        df = empty(spark, ddl)
    df = df.drop("bucket")
    return df.orderBy(*order_by) if order_by else df


def rows_of(spark: SparkSession, path: str, keys: DataFrame, ddl: str, key: str = "ticker") -> DataFrame:
    """The rows of some keys; of a table with a key layout only their buckets are read."""
    stored, keys = layout(spark, path), keys.select(key).distinct()
    if stored is None or stored[0] != key:
        return read_table(spark, path, ddl).join(keys, key, "left_semi")
    # At most as many small integers as there are buckets reach the driver.
    touched = [r.bucket for r in keys.select(bucket_of(F.col(key), stored[1]).alias("bucket")).distinct().collect()]
    rows = _stored(spark, path, ddl)
    if rows is None or "bucket" not in rows.columns:
        return empty(spark, ddl)
    return rows.filter(F.col("bucket").isin(touched)).drop("bucket").join(keys, key, "left_semi")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key, for work that costs much more per row than moving it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows), one count per table in one plan."""
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def column_types(df: DataFrame) -> DataFrame:
    """(column_name, n_values, n_numeric, is_numeric) for text columns, one aggregation.

    A column is numeric if it has values and every value casts.
    """
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    stats = df.agg(*[
        F.struct(F.lit(n).alias("column_name"), F.count(n).alias("n_values"),
                 F.count(F.col(n).try_cast("double")).alias("n_numeric")).alias(n)
        for n in names])
    return (stats.select(F.inline(F.array(*[F.col(n) for n in names])))
            .withColumn("is_numeric", (F.col("n_values") > 0)
                        & (F.col("n_values") == F.col("n_numeric"))))


def restore_types(df: DataFrame, keep_text: tuple[str, ...] = ()) -> DataFrame:
    """Cast the numeric text columns to double, except codes named in ``keep_text``.

    The decision is one row per column of the schema.
    """
    numeric = {r.column_name for r in column_types(df).filter("is_numeric").collect()}
    return df.select(*[F.col(c).cast("double") if c in numeric and c not in keep_text
                       else F.col(c) for c in df.columns])


def _layout_path(path: str) -> str:
    return f"{path}/_layout"


def layout(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """(key, buckets) that a table was written with; None if it has no key layout."""
    if not exists(spark, _layout_path(path)):
        return None
    row = spark.read.schema("key STRING, buckets INT").parquet(_layout_path(path)).first()
    return row["key"], row["buckets"]


def _keep_layout(spark: SparkSession, path: str, key: str, buckets: int) -> None:
    (spark.createDataFrame([(key, buckets)], "key STRING, buckets INT").coalesce(1)
     .write.mode("overwrite").parquet(_layout_path(path)))


def observed(df: DataFrame, metrics: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """The frame with its row count and other aggregates, which the first action on it yields by the way."""
    seen = Observation(f"observed-{uuid.uuid4().hex}")
    named = [column.alias(name) for name, column in (metrics or {}).items()]
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *named), seen


def metrics_of(seen: Observation) -> dict:
    """What was observed; a plan that Spark knows to be empty drops the observation, and has no rows."""
    try:
        return seen.get
    except Py4JJavaError:
        return {"n_rows": 0}


def write_table(df: DataFrame, path: str, key: str | None = None,
                buckets: int = BUCKETS, rebalance: bool = True, options: dict | None = None) -> None:
    """Full refresh.  With a key the files are laid out by key bucket.

    The key and the number of buckets are kept with the table.  The rebalance
    hint lets Spark split a bucket that is too large for one task and merge
    small ones, so a hot key does not write through a single task.  Rows made
    from the files of such a table need no ``rebalance``: their tasks have the
    rows of a bucket or a few already.
    """
    writer = df
    if key is not None:
        writer = df.withColumn("bucket", bucket_of(F.col(key), buckets))
        if rebalance:
            writer = writer.hint("rebalance", "bucket")
    writer = writer.write.mode("overwrite").options(**options or {}).option("partitionOverwriteMode", "static")
    if key is not None:
        writer = writer.partitionBy("bucket")
    writer.parquet(path)
    if key is not None:
        _keep_layout(df.sparkSession, path, key, buckets)


def write_colocated(df: DataFrame, path: str, key: str = "ticker", buckets: int = BUCKETS) -> None:
    """Full refresh as a table in Spark's buckets: one task holds all rows of a key, sorted by it.

    For tables with a bounded number of rows per key, such as statements and
    ratios; facts of a company that could outgrow a task belong in ``write_table``.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    # Every file holds one bucket only, and a bucket is written by one task.
    (df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key)
     .format("parquet").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")
    _keep_layout(spark, path, key, buckets)


def read_colocated(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table of ``write_colocated``: joins, windows and groupings by its key need no exchange."""
    key, buckets = layout(spark, path)
    name = f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back.

    Cuts the lineage with a table that survives lost executors, and gives Spark
    its true size for later join choices.
    """
    path = f"{checkpoint_root(df.sparkSession)}/staged/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def replace_by_key(rows: DataFrame, keys: DataFrame, path: str, key: str = "ticker",
                   buckets: int | None = None, run_id: str | None = None,
                   ddl: str | None = None) -> None:
    """Replace all rows of ``keys`` by ``rows``; rows of other keys stay.

    Rows of keys not listed are left out.  Only the buckets of the keys are read
    and written.  The number of buckets is the stored table's; ``buckets`` is
    for a new table.  A table without a key layout, with another key or with
    another number than the one given is refused.  The merged buckets are
    written to a staging table in the shared checkpoint folder and moved into
    place, so they are written once.  If publishing is interrupted, a run with
    the same ``run_id`` goes on with the staged buckets.  An empty key list
    changes nothing.  Give the schema of a large table as ``ddl``; without it
    new columns of ``rows`` are added.
    """
    spark = rows.sparkSession
    current = _stored(spark, path, ddl) if exists(spark, path) else None
    stored = layout(spark, path)
    if current is not None and stored is None:
        raise ValueError(f"Table at {path} has no key layout; write it with write_table(key=...) first")
    if stored is not None and (stored[0] != key or buckets not in (None, stored[1])):
        raise ValueError(f"Table at {path} is laid out by {stored[0]} in {stored[1]} buckets, "
                         f"not by {key} in {buckets}")
    count = stored[1] if stored else buckets or BUCKETS
    name = run_id or uuid.uuid4().hex
    stage = f"{checkpoint_root(spark)}/staged/{name}"
    keys = staged(keys.select(key).distinct(), f"{name}-keys")
    # At most as many small integers as there are buckets reach the driver.
    touched = sorted(r.bucket for r in keys.select(
        bucket_of(F.col(key), count).alias("bucket")).distinct().collect())
    if touched:
        merged = added = rows.join(keys, key, "left_semi") \
            .withColumn("bucket", bucket_of(F.col(key), count))
        if current is not None and "bucket" in current.columns:
            kept = current.filter(F.col("bucket").isin(touched)).join(keys, key, "left_anti")
            merged = kept.unionByName(added, allowMissingColumns=True)
        if not exists(spark, f"{stage}/_SUCCESS"):
            (merged.hint("rebalance", "bucket").write.mode("overwrite")
             .option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(stage))
            filled = [(b,) for b in touched if exists(spark, f"{stage}/bucket={b}")]
            (spark.createDataFrame(filled, "bucket INT").coalesce(1)
             .write.mode("overwrite").parquet(f"{stage}-filled"))
        if stored is None:
            _keep_layout(spark, path, key, count)
        _publish(spark, stage, path, touched)
    for folder in (stage, f"{stage}-keys", f"{stage}-filled"):
        drop_path(spark, folder)


def _publish(spark: SparkSession, stage: str, path: str, touched: list[int]) -> None:
    """Move the staged buckets into place; a touched bucket that is empty now is removed.

    Each step may be repeated: a bucket that is not in the stage any more has
    been moved before.
    """
    filled = {r.bucket for r in spark.read.schema("bucket INT").parquet(f"{stage}-filled").collect()}
    for bucket in touched:
        source, target = f"{stage}/bucket={bucket}", f"{path}/bucket={bucket}"
        if bucket not in filled:
            drop_path(spark, target)
        elif exists(spark, source):
            drop_path(spark, target)
            fs, from_ = _fs(spark, source)
            if not fs.rename(from_, _fs(spark, target)[1]):
                raise OSError(f"Could not move {source} to {target}")
