"""Text expressions: markup to text, section between headings, chunks.

Everything is a built-in expression over the whole text, except the full entity
table, which a pandas UDF resolves for the texts that need it.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space of every alphabet, as strip() and \s see it in Unicode mode.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680,
                             *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))
WS = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in WS_CHARS) + "]"

# Patterns of the markup cleaner.
DROPPED_BLOCKS = r"(?is)<(script|style|head).*?</\1>"
BLOCK_TAGS = r"(?i)</?(p|div|br|tr|li|h[1-6]|table|td)[^>]*>"
ANY_TAG = r"<[^>]+>"

_ALL = 2**31 - 1

# Entities common in filings, resolved without leaving the JVM.
COMMON_ENTITIES = ["quot", "lt", "gt", "nbsp", "copy", "reg", "trade", "middot", "bull",
                   "ndash", "mdash", "lsquo", "rsquo", "ldquo", "rdquo", "sect",
                   "#39", "#160", "#8211", "#8212", "#8217", "#8220", "#8221", "amp"]
_UNCOMMON = "&(?!(?:" + "|".join(COMMON_ENTITIES) + ");)(?=#|[A-Za-z])"
_ENDED = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
_UNCOMMON_ENDED = "&(?!(?:" + "|".join(COMMON_ENTITIES) + ");)" + _ENDED[1:]


def strip(text: Column) -> Column:
    """Looks at both ends only, unlike a pattern that scans the whole text."""
    return F.btrim(text, F.lit(WS_CHARS))


@F.pandas_udf(StringType())
def _unescape_all(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def _ended(found: re.Match) -> str:
    ref = found[0]
    return html.unescape(ref) if ref[1] == "#" else html.entities.html5.get(ref[1:], ref)


@F.pandas_udf(StringType())
def _unescape_ended(text: pd.Series) -> pd.Series:
    return text.map(lambda t: re.sub(_ENDED, _ended, t), na_action="ignore")


def unescape_full(text: Column) -> Column:
    """All entities; the pandas call does work only on texts with a rare one."""
    rare = F.when(F.coalesce(text, F.lit("")).rlike(_UNCOMMON), text)
    return F.coalesce(_unescape_all(rare), unescape(text))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    A one-element transform: unlike a projected column, the optimizer cannot
    copy the expression into the places (or lambdas) where it is used.
    """
    return F.transform(F.array(value), body)[0]


def _common(text: Column) -> Column:
    """One pass: cut at every ampersand and look at the start of each piece."""
    def resolve(piece: Column, at: Column) -> Column:
        out = F.when(at == 0, piece)
        for name in COMMON_ENTITIES:
            head = f"{name};"
            out = out.when(F.startswith(piece, F.lit(head)), F.concat(
                F.lit(html.unescape(f"&{head}")), F.substring(piece, len(head) + 1, _ALL)))
        return out.otherwise(F.concat(F.lit("&"), piece))

    return F.array_join(F.transform(F.split(text, "&"), resolve), "")


def unescape(text: Column) -> Column:
    """Common entities to characters, without leaving the JVM."""
    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), _common(t)).otherwise(t))


def with_text(df: DataFrame, markup: str, out: str = "text",
              full_entities: bool = True, ended_only: bool = False) -> DataFrame:
    """Adds the plain text of a markup column; paragraph breaks are kept.

    The stages are columns of their own and each is used more than once by the
    next, so Spark evaluates every stage once.  Texts with common entities only
    stay in the JVM; with ``full_entities`` the others go through the entity
    table of a pandas UDF, which sees null for all the rest.  With
    ``ended_only`` a reference without its semicolon is text.
    """
    bare = F.regexp_replace(F.col(markup), DROPPED_BLOCKS, " ")
    bare = F.regexp_replace(bare, BLOCK_TAGS, "\n")
    rows = df.withColumn("_bare", F.regexp_replace(bare, ANY_TAG, " "))
    plain = F.when(F.contains("_bare", F.lit("&")), _common(F.col("_bare"))) \
        .otherwise(F.col("_bare"))
    if full_entities:
        pattern, resolved = (_UNCOMMON_ENDED, _unescape_ended) if ended_only else (_UNCOMMON, _unescape_all)
        rare = F.when(F.col("_bare").rlike(pattern), F.col("_bare"))
        plain = F.coalesce(resolved(rare), plain)
    t = F.replace(plain, F.lit("\u00a0"), F.lit(" "))
    t = F.replace(t, F.lit("\u2019"), F.lit("'"))
    # Single blanks and bare line ends stay as they are, so only the others match.
    t = F.regexp_replace(F.replace(t, F.lit("\t"), F.lit(" ")), " {2,}", " ")
    t = F.regexp_replace(t, " \n ?|\n ", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return rows.withColumn(out, strip(t)).drop("_bare")


# Heading patterns (start, end) per form, and size limits.
_S = WS + "*"
_MARK = rf"{_S}[.:\-–—]?{_S}"
SECTION_BOUNDS = {
    "10-K": (rf"item{_S}7{_MARK}management",
             rf"item{_S}7a{_MARK}quantitative|item{_S}8{_MARK}financial{WS}+statements"),
    "10-Q": (rf"item{_S}2{_MARK}management",
             rf"item{_S}3{_MARK}quantitative|item{_S}4{_MARK}controls"),
}
MIN_SECTION, MAX_SECTION, END_OFFSET = 2000, 400_000, 100


def _section(text: Column, start: str, end: str) -> Column:
    # Both lookaheads are empty matches, so every start heading opens a candidate.
    pattern = rf"(?is)(?={start})(?=(.{{{END_OFFSET}}}.*?)({end}|\z))"
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    heads = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    # Without an end heading the candidate is cut before it is trimmed, which
    # matters only above the size limit; only then the end headings are looked at.
    return let(bodies, lambda found: _latest_long(
        F.when(F.exists(found, lambda b: F.length(b) > MAX_SECTION), F.zip_with(
            found, heads, lambda b, h: F.when(h != "", strip(b)).otherwise(
                strip(F.substring(b, 1, MAX_SECTION)))))
        .otherwise(F.transform(found, strip))))


def _latest_long(candidates: Column) -> Column:
    long_enough = F.filter(candidates, lambda x: F.length(x) >= MIN_SECTION)
    return F.substring(F.try_element_at(long_enough, F.lit(-1)), 1, MAX_SECTION)


def extract_section(text: Column, form: Column) -> Column:
    """The management discussion: the latest start heading with enough text; null if none."""
    annual = _section(text, *SECTION_BOUNDS["10-K"])
    quarterly = _section(text, *SECTION_BOUNDS["10-Q"])
    return F.when(form == "10-Q", quarterly).otherwise(annual)


CHUNK_TARGET = 1400


def chunk_text(text: Column, target: int = CHUNK_TARGET, separator: str = "\n\n") -> Column:
    """Whole text -> array of chunks packed from paragraphs.

    Paragraphs join with a blank line while the chunk stays within the target;
    a buffer above twice the target is cut into target-sized pieces.
    """
    paragraphs = F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def pack(acc: Column, p: Column) -> Column:
        out, buf = acc["out"], acc["buf"]
        full = (buf != "") & (F.length(buf) + F.length(p) + 2 > target)
        joined = F.when(full | (buf == ""), p).otherwise(F.concat(buf, F.lit("\n\n"), p))
        return cut(F.when(full, F.array_append(out, buf)).otherwise(out), joined)

    def cut(out: Column, buf: Column) -> Column:
        def split_long(x: Column) -> Column:
            over = F.length(x["buf"]) - 2 * target
            n = F.ceil(over / target).cast("int")
            pieces = F.regexp_extract_all(x["buf"], F.lit(f"(?s).{{1,{target}}}"), F.lit(0))
            return F.when(over > 0, F.struct(
                F.concat(x["out"], F.slice(pieces, F.lit(1), n)).alias("out"),
                F.substring(x["buf"], n * target + 1, F.length(x["buf"])).alias("buf"))
            ).otherwise(x)

        return let(F.struct(out.alias("out"), buf.alias("buf")), split_long)

    return F.aggregate(paragraphs, empty, pack, lambda acc: F.when(
        acc["buf"] != "", F.array_append(acc["out"], acc["buf"])).otherwise(acc["out"]))


def query_words(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), " "), lambda w: w != "")
