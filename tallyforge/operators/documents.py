"""Document jobs: section table, chunk table, keyword search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from tallyforge.functions.text import (CHUNK_TARGET, chunk_text, extract_section, let,
                                       query_words, with_text)
from tallyforge.operators.segments import segment_entries, unpack_segments

TOP_PASSAGES = 6
EXCERPT_CHARS = 1200
REQUEST_BATCH = 64


def recent_filings(filings: DataFrame, n: int = 2, form: str = "10-K",
                   key: str = "ticker") -> DataFrame:
    """The n newest filings of a form per company, ranked from 1."""
    newest = Window.partitionBy(key).orderBy(F.col("filing_date").desc_nulls_last(),
                                             F.col("accession_number").desc())
    return (filings.filter(F.col("form") == form)
            .withColumn("filing_rank", F.row_number().over(newest))
            .filter(F.col("filing_rank") <= n))


def filing_documents(newest: DataFrame, documents: DataFrame) -> DataFrame:
    """Landed markup of the chosen filings: the primary document, not its exhibits.

    Joined on all of cik, accession number and document name that both sides have.

    An inner join, so that the narrow filing side can be the broadcast side and
    the markup is not shuffled.  Spark decides by size: pass ``newest`` as a
    written table, whose size is known before the plan is made.
    """
    keys = [c for c in ("cik", "accession_number", "primary_document")
            if c in documents.columns and c in newest.columns]
    return documents.join(newest, keys)


_MDNA_KEYS = ["ticker", "cik", "form", "accession_number", "filing_date"]


def _with_status(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("char_count", F.coalesce(F.length("mdna_text"), F.lit(0)).cast("bigint"))
            .withColumn("extraction_ok", F.col("mdna_text").isNotNull()))


def mdna_table(filing_docs: DataFrame) -> DataFrame:
    """One row per filing with the extracted section; a failure is a row, not an error."""
    section = extract_section(F.col("text"), F.col("form"))
    return _with_status(with_text(filing_docs, "html")
                        .select(*_MDNA_KEYS, section.alias("mdna_text")))


def document_results(filing_docs: DataFrame) -> DataFrame:
    """Section and segments of each filing in one pass over the markup.

    Segments are taken from the newest filing of a company only.
    """
    section = extract_section(F.col("text"), F.col("form"))
    segments = F.when(F.col("filing_rank") == 1, segment_entries(F.col("html")))
    return with_text(filing_docs, "html").select(
        *_MDNA_KEYS, section.alias("mdna_text"), segments.alias("segments"))


def mdna_of(results: DataFrame, newest: DataFrame) -> DataFrame:
    """Section rows of the chosen filings; without a landed document the text is null."""
    absent = newest.join(results.select("accession_number"), "accession_number", "left_anti")
    no_text = absent.select(*_MDNA_KEYS, F.lit(None).cast("string").alias("mdna_text"))
    return _with_status(results.drop("segments").unionByName(no_text))


def segments_of(results: DataFrame) -> DataFrame:
    return unpack_segments(results, F.col("segments"), ("ticker", "accession_number"))


def chunk_table(mdna: DataFrame, target: int = CHUNK_TARGET, separator: str = "\n\n") -> DataFrame:
    """Chunks of the successful sections, numbered from 0 inside a filing."""
    # A condition on the text, not a filter: a filter would be pushed below the
    # extraction and evaluate it a second time.  A null text yields no chunks.
    text = F.when(F.col("extraction_ok"), F.col("mdna_text"))
    return mdna.select("ticker", "form", "filing_date", "accession_number",
                       F.posexplode(chunk_text(text, target, separator))
                       .alias("chunk_id", "chunk_text"))


def _request_batches(requests: DataFrame, batch: int) -> DataFrame:
    """Requests in batches of about ``batch`` per ticker: (ticker, batch).

    The batch number comes from a hash over as many buckets as the ticker's
    request count needs, so one popular ticker becomes many rows, not one.  A
    request refers to its words by their position in the batch's vocabulary.
    """
    asked = requests.select("request_id", F.upper("ticker").alias("ticker"),
                            # A request without a query has no words; null would empty its batch.
                            query_words(F.coalesce("query", F.lit(""))).alias("words"))
    sizes = asked.groupBy("ticker").agg(F.ceil(F.count(F.lit(1)) / batch).alias("_n"))
    batches = (asked.join(sizes, "ticker")
               .withColumn("_batch", F.pmod(F.xxhash64("request_id"), F.col("_n")))
               .groupBy("ticker", "_batch")
               .agg(F.collect_list(F.struct("request_id", "words")).alias("_asked")))
    # The vocabulary is bound once; as a column it would be rebuilt for every word.
    packed = let(F.array_distinct(F.flatten(F.col("_asked.words"))), lambda v: F.struct(
        F.array_join(v, " ").alias("vocabulary"), F.transform("_asked", lambda r: F.struct(
            r["request_id"].alias("request_id"),
            F.transform(r["words"], lambda w: F.array_position(v, w).cast("int")).alias("at")))
        .alias("requests")))
    return batches.select("ticker", packed.alias("batch"))


@F.pandas_udf(ArrayType(BooleanType()))
def _held(text: pd.Series, vocabulary: pd.Series) -> pd.Series:
    """Which words of a vocabulary, joined by blanks, the text holds; Python's search is several times faster than Spark's."""
    words = {v: v.split(" ") for v in vocabulary.unique()}
    # A null text holds no word.
    return pd.Series([[t is not None and w in t for w in words[v]] for t, v in zip(text, vocabulary)])


def _scores(held: Column) -> Column:
    """Scores above zero of a batch's requests: every vocabulary word was looked up once."""
    return F.filter(
        F.transform("batch.requests", lambda r: F.struct(
            r["request_id"].alias("request_id"),
            F.size(F.filter(r["at"], lambda i: F.element_at(held, i))).alias("score"))),
        lambda x: x["score"] > 0)


def search_passages(requests: DataFrame, chunks: DataFrame, top: int = TOP_PASSAGES,
                    batch: int = REQUEST_BATCH) -> DataFrame:
    """Best passages for a table of requests (request_id, ticker, query).

    The score is the number of query words the passage contains, repeated words
    counted again.  Scoring passes each chunk once per request batch of its
    ticker and emits keys only; every map task keeps its best rows per request
    before the shuffle (WindowGroupLimit).  The text of the winners is fetched by
    a second, keyed scan, so no passage text is ever sorted.
    """
    scored = (chunks.select(F.upper("ticker").alias("ticker"), "filing_date",
                            "accession_number", "chunk_id",
                            F.lower("chunk_text").alias("_text"))
              .join(_request_batches(requests, batch), "ticker")
              .select("filing_date", "accession_number", "chunk_id", "batch",
                      _held("_text", "batch.vocabulary").alias("_held"))
              .select("filing_date", "accession_number", "chunk_id",
                      F.inline(_scores(F.col("_held")))))
    best = Window.partitionBy("request_id").orderBy(
        F.col("score").desc(), F.col("filing_date").desc_nulls_last(), "chunk_id",
        "accession_number")
    winners = (scored.withColumn("rank", F.row_number().over(best))
               .filter(F.col("rank") <= top))
    texts = chunks.select("accession_number", "chunk_id",
                          F.substring("chunk_text", 1, EXCERPT_CHARS).alias("excerpt"))
    return (winners.join(texts, ["accession_number", "chunk_id"])
            .select("request_id", F.col("rank").cast("bigint").alias("rank"), "filing_date",
                    F.col("score").cast("bigint").alias("score"), "accession_number",
                    "chunk_id", "excerpt"))
