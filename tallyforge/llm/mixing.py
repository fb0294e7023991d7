"""Mixing sources to target weights.

Every document gets a hash-random key.  A source is cut into buckets of that
key, each of a bounded number of documents; bucket totals are summed along the
source, then sizes within the bucket, so a source that holds a third of all
rows is summed by many tasks.  The sum says where the source's budget ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import stage, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"
DOCS_PER_BUCKET = 4096


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``source_rank``, ``target`` and ``budget`` to one row per source.

    Targets share ``share`` times the total size by weight.  A target stops at
    ``max_epochs`` times its source's size; the excess goes to the others by
    weight until none is above.  In the order of size over weight the stopped
    sources come first, so one pass of running sums finds them.
    """
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("cap_per_weight", "source_rank")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        sources
        .withColumn("source_rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(pattern, ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
        .withColumn("pool", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("stopped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everything)
                    - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("fits", (F.col("pool") - F.col("stopped")) * F.col("weight") / F.col("open_weight") <= F.col("cap"))
        .withColumn("level", F.first(F.when(F.col("fits"), F.struct("pool", "stopped", "open_weight")),
                                     ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding,
                                                                                 W.unboundedFollowing)))
    )
    shared = (F.col("level.pool") - F.col("level.stopped")) * F.col("weight") / F.col("level.open_weight")
    return (
        ranked
        .withColumn("target", F.coalesce(F.least("cap", shared), F.col("cap")))
        .withColumn("budget", F.floor("target"))
        .select("source", "source_rank", "n_docs", "source_size", "target", "budget")
    )


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                max_epochs: int = MAX_EPOCHS, seed: str = SEED, docs_per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """Words that the mix takes of each document.

    Returns one row per row of ``docs`` (``doc_id``, ``text``, ``source``):
    doc_id, source, size (words), source_size, target (the source's), taken.
    Whole epochs take every document of a source; the rest of the budget takes
    documents in the order of their keys, the last one in part, so that the
    taken words of a source equal its target without its fraction.

    Null and empty texts have size 0 and are taken with 0 words.  A null source
    is a source of its own.  Rows that share a doc_id are documents of their
    own; ties are ordered by size.  A null doc_id has a key as well.  An empty
    table gives no rows.  Other columns are not read.
    """
    sized = stage(docs.select(
        F.col("doc_id"), F.col("source"), word_count("text").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("mix_key"),
    ))
    sources = source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")),
        weights, share, max_epochs)
    fraction = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    right = sources.withColumnRenamed("source", "source_name")
    placed = (
        sized.join(right, sized["source"].eqNullSafe(right["source_name"]))
        .withColumn("bucket", F.floor(fraction * F.ceil(F.col("n_docs") / F.lit(docs_per_bucket))))
    )
    totals = placed.groupBy("source_rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = W.partitionBy("source_rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("source_rank", "bucket",
                           F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("size_before"))
    inside = (W.partitionBy("source_rank", "bucket").orderBy("mix_key", "doc_id", "size")
              .rowsBetween(W.unboundedPreceding, -1))
    start = F.col("size_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    left = F.col("budget") - F.col("epochs") * F.col("source_size")
    return (
        placed.join(totals, ["source_rank", "bucket"])
        .withColumn("start", start).withColumn("epochs", epochs)
        .select("doc_id", "source", "size", "source_size", "target",
                (F.col("epochs") * F.col("size")
                 + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("start")))).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with the columns of ``docs``, repeated by epoch.

    A document comes as often as its taken words round to whole copies; one
    without words comes once.
    """
    ids = docs.columns
    taken = mix_sources(docs, **options).select(
        F.col("doc_id").alias("mix_doc_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"),
        F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(1.0)).cast("int")
        .alias("mix_copies"))
    each = W.partitionBy("mix_doc_id", "mix_source", "mix_size")
    numbered = taken.withColumn("mix_nth", F.row_number().over(each.orderBy("mix_copies")))
    own = W.partitionBy("doc_id", "source", "mix_words")
    rows = docs.withColumn("mix_words", word_count("text"))
    rows = rows.withColumn("mix_n", F.row_number().over(own.orderBy("text")))
    return (
        rows.join(numbered, rows["doc_id"].eqNullSafe(numbered["mix_doc_id"])
                  & rows["source"].eqNullSafe(numbered["mix_source"])
                  & (rows["mix_words"] == numbered["mix_size"]) & (rows["mix_n"] == numbered["mix_nth"]))
        .filter(F.col("mix_copies") > 0)
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
        .select(*ids)
    )


def op4_mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS pool
  FROM sources),
running AS (
  SELECT *, coalesce(sum(cap) OVER before, 0.0::DOUBLE) AS stopped,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0.0::DOUBLE) AS open_weight
  FROM weighed WINDOW before AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT pool - stopped AS rest, open_weight AS ow FROM running
  WHERE (pool - stopped) * w / open_weight <= cap ORDER BY cap / w, r LIMIT 1),
targets AS (
  SELECT source, source_size, coalesce(least(cap, rest * w / ow), cap) AS target
  FROM running LEFT JOIN level ON true),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END
                                           * source_size - start)))::BIGINT AS taken
FROM placed
"""
