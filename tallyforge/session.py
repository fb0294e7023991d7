"""Session settings shared by the jobs, the tests and the benchmark."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings that hold at any size.  ANSI mode is left on: the operators use
# try_divide and try_cast where a bad value must become null.
COMMON_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: int | str = "*", app: str = "tallyforge",
                  shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark.

    On a cluster the caller builds the session; only ``COMMON_CONF`` matters there.
    """
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for key, value in COMMON_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOT: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``, with or without a scheme:
    a path without one belongs to the default file system of driver and
    executors alike, which may be a mounted folder.  Where it is unset, the
    warehouse serves, which a cluster shares for its tables.  Only a session in
    one process without that setting (tests on one machine) gets a temporary
    folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if "path" not in _LOCAL_ROOT:
        _LOCAL_ROOT["path"] = tempfile.mkdtemp(prefix="tallyforge-")
    return _LOCAL_ROOT["path"]
