"""Landed XML feeds and price files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import strip, unescape_full
from tallyforge.sources.landing import file_stem, read_documents

_NAME_SUFFIX = r"\s*\(\d{7,10}\)\s*\z"


def _element(xml: Column, tag: str) -> Column:
    """Raw text of the first such element; empty if absent."""
    return F.regexp_extract(xml, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)


def _plain(raw: Column) -> Column:
    """Element text: CDATA unwrapped, otherwise entities resolved."""
    cdata = F.regexp_extract(raw, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", 1)
    return F.when(cdata != "", cdata).otherwise(unescape_full(raw))


def roster_entries(feeds: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """Atom roster: (keys, company, cik), one row per company name, first wins.

    The order inside a feed is (document, position); the window key holds the
    company name, so a long feed is spread.
    """
    entries = F.regexp_extract_all(F.col(column), F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))
    rows = feeds.select(*keys, "doc", F.posexplode(entries).alias("pos", "entry"))
    rows = rows.filter(F.col("entry").rlike(r"(?s)<title>.*?</title>")).select(
        *keys, "doc", "pos",
        F.regexp_replace(strip(unescape_full(_element(F.col("entry"), "title"))), _NAME_SUFFIX, "")
        .alias("company"),
        F.regexp_extract("entry", r"CIK=(\d{4,10})", 1).try_cast("bigint").alias("cik"))
    first = Window.partitionBy(*keys, "company").orderBy("doc", "pos")
    return (rows.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
            .select(*keys, "company", "cik"))


def news_items(feeds: DataFrame, column: str, keys: tuple[str, ...], n: int = 3) -> DataFrame:
    """RSS items: (keys, pos, title, link, date), the first n of each feed."""
    items = F.regexp_extract_all(F.col(column), F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))
    rows = feeds.select(*keys, F.posexplode(F.slice(items, 1, n)).alias("pos", "item"))
    item = F.col("item")
    return rows.select(*keys, F.col("pos").cast("bigint").alias("pos"),
                       _plain(_element(item, "title")).alias("title"),
                       _plain(_element(item, "link")).alias("link"),
                       F.substring(_plain(_element(item, "pubDate")), 1, 16).alias("date"))


def read_prices(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Daily closes from one CSV file per ticker.

    Date and Close are found by name in the header of each file, so files of one
    folder may order their columns differently.
    """
    files = read_documents(spark, path)

    def cells(line: Column) -> Column:
        return F.transform(F.split(line, ","), lambda x: F.btrim(strip(x), F.lit('"')))

    lines = F.split("value", r"\r\n|\n|\r")
    rows = files.select(
        F.upper(file_stem(F.col("file_path"))).alias("ticker"), cells(F.regexp_replace(lines[0], "^\ufeff", "")).alias("names"),
        F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))

    def named(name: str) -> Column:
        at = F.array_position("names", name).cast("int")
        return F.when(at > 0, F.try_element_at(cells(F.col("line")), F.nullif(at, F.lit(0))))

    return rows.select("ticker", named("Date").try_cast("date").alias("date"),
                       named("Close").try_cast("double").alias("close"), F.lit(source).alias("source")) \
        .filter(F.col("date").isNotNull() & F.col("close").isNotNull())
