"""Incremental ingestion: landed company documents replace their companies' facts."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.functions.scalar import normal_ticker
from tallyforge.schemas import FACTS, VERSIONS
from tallyforge.session import checkpoint_root
from tallyforge.sources.landing import facts_or_mark, file_stem
from tallyforge.sources.tables import drop_path, read_table, replace_by_key, staged


def versions_path(table: str) -> str:
    return f"{table}-versions"


def changes_path(table: str) -> str:
    return f"{table}-changes"


def record_changes(tickers: DataFrame, table: str, run: str) -> None:
    """Add the tickers that a run changed to the table's change set; a repeated run is recorded once."""
    (tickers.select("ticker", F.lit(run).alias("run")).distinct().write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(changes_path(table)))


def _file_time(docs: DataFrame) -> Column:
    if docs.schema["file_time"].dataType.typeName().startswith("timestamp"):
        return F.unix_micros("file_time")
    return F.col("file_time").cast("bigint")


def apply_batch(docs: DataFrame, table: str, buckets: int | None = None,
                run_id: str | None = None) -> None:
    """Replace the facts of every ticker whose newest readable document is newer than the stored one.

    Documents are ordered by file time, then path.  The order of what is stored
    is kept per ticker beside the table, so an older file that lands in a later
    batch changes nothing, and landings in any order and split give one result.
    A document no newer than the stored one is not parsed.  The tickers that
    changed are written to the change set under the run's name; versions come
    last, so a batch that is replayed after an interruption does the same again.
    """
    spark = docs.sparkSession
    run = run_id or uuid.uuid4().hex
    order = ["file_time", "file_path"]
    landed = docs.withColumn("file_time", _file_time(docs))
    tickers = staged(landed.select("ticker").distinct(), f"{run}-landed")
    stored = (read_table(spark, versions_path(table), VERSIONS).join(tickers, "ticker", "left_semi")
              .select("ticker", F.struct(*order).alias("stored")))
    newer = (landed.join(stored, "ticker", "left")
             .filter(F.col("stored").isNull() | (F.struct(*order) > F.col("stored"))).drop("stored"))
    rows = staged(facts_or_mark(newer, keep=tuple(order)), f"{run}-facts")
    chosen = staged(rows.filter("readable").groupBy("ticker").agg(F.max(F.struct(*order)).alias("version"))
                    .select("ticker", "version.*"), f"{run}-chosen")
    facts = rows.filter("tag IS NOT NULL").join(chosen, ["ticker", *order], "left_semi").drop("readable", *order)
    replace_by_key(facts, chosen, table, buckets=buckets, run_id=run, ddl=FACTS)
    record_changes(chosen, table, run)
    replace_by_key(chosen, chosen, versions_path(table), buckets=buckets, run_id=f"{run}-versions", ddl=VERSIONS)
    for name in ("landed", "facts", "chosen"):
        drop_path(spark, f"{checkpoint_root(spark)}/staged/{run}-{name}")


def landed_files(spark: SparkSession, landing: str) -> DataFrame:
    """Stream of whole files named by their ticker: (value, file_path, file_time, ticker)."""
    return (spark.readStream.format("text").option("wholetext", True).load(landing)
            .select("value", F.col("_metadata.file_path").alias("file_path"),
                    F.col("_metadata.file_modification_time").alias("file_time"))
            .withColumn("ticker", normal_ticker(file_stem(F.col("file_path")))))


def ingest_available(stream: DataFrame, table: str, checkpoint: str,
                     buckets: int | None = None) -> StreamingQuery:
    """Process everything that has landed since the last run, then stop.

    Replacing by key makes a replayed batch harmless.  The staging name is made
    of the checkpoint and the batch, so a batch that failed while publishing is
    published from its staged rows when Spark replays it.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{batch_id}"
        apply_batch(batch, table, buckets, run_id)

    query = (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
