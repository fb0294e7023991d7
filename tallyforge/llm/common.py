"""Small helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; a cluster must
    name one that all executors share.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not configured and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="corpus-checkpoint-"))
    return configured or context.getCheckpointDir()


#: For rows of megabytes: unless told so, Parquet's writer counts bytes from the 100th row on, and its reader takes a
#: whole row group at once.
ROW_BY_ROW = {"parquet.block.row.count.limit": 1}


def stage(df: DataFrame, options: dict | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet; what follows starts from the files.

    Unlike a checkpoint, the files also give the planner the true size.  They
    are deleted when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    staged = spark.read.schema(df.schema).parquet(folder)
    staged.staged_in = folder
    return staged


def stage_by(df: DataFrame, key: str, buckets: int, options: dict | None = None) -> DataFrame:
    """Like ``stage``, in Spark's buckets of a key: joins and groups by the key move other rows only, not these."""
    spark, name = df.sparkSession, f"stage_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    (df.write.options(**options or {}).option("path", folder).bucketBy(buckets, key).format("parquet")
     .saveAsTable(name))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    staged = spark.table(name)
    # The frame knows its files; the catalog need not.
    spark.sql(f"DROP TABLE {name}")
    staged.staged_in = folder
    return staged


def unstage(staged: DataFrame) -> None:
    """Delete the files of a staged frame that nothing will read any more."""
    path = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(staged.staged_in)
    path.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Free memory goes back to the system: a worker goes on to other groups and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column | str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
