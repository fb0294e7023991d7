"""Segment revenue from inline markup, one map over each document.

Contexts and facts of a document are arrays in its row and are joined there, so
nothing is shuffled.  One pattern reads all fields of a context or of a fact's
tag at once.  Looking up an array is a scan, so in a document with many pairs of
contexts and facts, sorted arrays are bisected instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import WS, let
from tallyforge.taxonomy import REVENUE_TAGS

# Markup patterns, axes in order of preference, number format.
CONTEXT = r'(?is)<xbrli:context[^>]*id="[^"]+"[^>]*>.*?</xbrli:context>'
# A context in one pass, tag by tag: (1) id, (2) axis, (3) member, (6) first start, (8) first end.  An empty group
# marks what was met: (5) a member, (4) a second one, which rules the context out, (7) a start, (9) an end.
CONTEXT_FIELDS = (
    r'(?is)\A<xbrli:context[^>]*id="([^"]+)"[^>]*>[^<]*(?:'
    r'<xbrldi:explicitMember[^>]*dimension="([^"]+)"[^>]*>\s*([^<\x20\t\n\x0B\f\r]+)\s*(?=<)(?:\5()|())'
    r'|(?!\7)<xbrli:startDate>([\d\-]+)</xbrli:startDate>()[^<]*'
    r'|(?!\9)<xbrli:endDate>([\d\-]+)</xbrli:endDate>()[^<]*'
    r'|<[^<]*)*+\z\5\7\9(?!\4)')
FACT = r"(?is)<ix:nonFraction[^>]*>.*?</ix:nonFraction>"
# One attribute after the other: the last value of each name is kept, an absent one is empty.
FACT_OPEN = (r"(?s)\A(?i:<ix:nonFraction)(?:" + "".join(rf'{name}="([^">]*)"|' for name in ("name", "contextRef", "scale", "sign"))
             + r'[A-Za-z0-9_:\-]++(?:="[^">]*")?|[^>])*+>')
AXES = ["srt:ProductOrServiceAxis", "us-gaap:StatementBusinessSegmentsAxis"]
NUMBER = rf"\A(?:(?!\d){WS}+)?(\d+(?:\.\d+)?)(?:\z|{WS}+\z)"
MIN_DAYS, MAX_DAYS = 340, 390

#: Contexts times facts, above which sorted arrays are bisected.
LARGE = 10_000


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def pretty_member(member: Column) -> Column:
    """'aapl:IPhoneMember' -> 'IPhone'; 'CloudServicesSegmentMember' -> 'Cloud Services'."""
    local = F.element_at(F.split(member, ":"), -1)
    local = F.regexp_replace(local, "(Segment)?Member$", "")
    spaced = F.trim(F.regexp_replace(local, "(?<=[a-z0-9])(?=[A-Z])", " "))
    return F.when(spaced == "", member).otherwise(spaced)


def _contexts(markup: Column) -> Column:
    """Array of (id, axis, member, start, end) of usable single-axis contexts."""
    def parse(piece: Column) -> Column:
        # A quote opens each field; only the last one, the member, may hold quotes.
        fields = F.split(F.regexp_replace(piece, CONTEXT_FIELDS, '"$6"$8"$1"$2"$3'), '"', 6)
        return let(fields, lambda f: F.when(F.get(f, F.lit(0)) == "", F.struct(
            f[3].alias("id"), f[4].alias("axis"), f[5].alias("member"),
            f[1].try_cast("date").alias("start"), f[2].try_cast("date").alias("end"))))

    # Most contexts name neither axis; they are dropped before they are parsed.
    pieces = F.filter(_all(markup, CONTEXT, 0), lambda p: F.contains(p, F.lit(AXES[0]))
                      | F.contains(p, F.lit(AXES[1])))
    return F.filter(F.transform(pieces, parse), lambda c: c["axis"].isin(AXES)
                    & c["start"].isNotNull() & c["end"].isNotNull())


def _facts(markup: Column) -> Column:
    """Array of revenue facts in document order: name, context id, scale, sign and content after an empty field."""
    names = [f"us-gaap:{t}" for t in REVENUE_TAGS]
    mentioned = f'"us-gaap:(?:{"|".join(REVENUE_TAGS)})"'
    pieces = F.filter(_all(markup, FACT, 0), lambda p: p.rlike(mentioned))
    fields = F.transform(pieces, lambda p: F.split(F.regexp_replace(p, FACT_OPEN, '"$1"$2"$3"$4"'), '"', 6))
    return F.filter(fields, lambda f: f[1].isin(names))


def _value(fact: Column) -> Column:
    """The number of a fact; null if its content or its scale is unreadable."""
    raw = F.regexp_replace(fact[5], "<[^>]+>|[, ]", "")
    # Casting an empty text costs an exception.
    number = let(F.regexp_extract(raw, NUMBER, 1), lambda n: F.when(n != "", n.try_cast("double")))
    scale = F.coalesce(F.nullif(fact[3], F.lit("")), F.lit("0")).try_cast("int")
    return number * F.pow(F.lit(10.0), scale) * F.when(fact[4] == "-", -1.0).otherwise(1.0)


def _scanned(contexts: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` with a function from an id to its last context, found by a scan; null if there is none."""
    ids = F.reverse(F.transform(contexts, lambda c: c["id"]))
    return let(ids, lambda i: body(lambda id_: F.get(
        contexts, F.size(i) - F.array_position(i, id_).cast("int"))))


def _bisected(contexts: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """The same over contexts sorted by id and place."""
    ordered = F.sort_array(F.transform(contexts, lambda c, i: F.struct(c["id"].alias("id"), i.alias("at"), c.alias("c"))))
    # Powers of two from the size down; their sum reaches every count of ids up to the one looked for.
    steps = lambda o: F.filter(F.array(*[F.lit(2**k) for k in range(30, -1, -1)]), lambda s: s <= F.size(o))

    def find(o: Column, s: Column, id_: Column) -> Column:
        upto = F.aggregate(s, F.lit(0), lambda n, step: F.when(
            F.get(o, n + step - 1)["id"] <= id_, n + step).otherwise(n))
        return let(F.get(o, upto - 1), lambda last: F.when(last["id"] == id_, last["c"]))

    return let(ordered, lambda o: let(steps(o), lambda s: body(lambda id_: find(o, s, id_))))


def _first_per_member(rows: Column) -> Column:
    return let(F.transform(rows, lambda x: x["member"]), lambda members: F.filter(
        rows, lambda x, i: F.array_position(members, x["member"]) == i + 1))


def _first_in_order(rows: Column) -> Column:
    """The same over rows sorted by member and place."""
    ordered = F.sort_array(F.transform(rows, lambda x, i: F.struct(x["member"].alias("member"), i.alias("at"), x.alias("x"))))
    return let(ordered, lambda o: F.transform(
        F.filter(o, lambda x, i: (i == 0) | (F.get(o, i - 1)["member"] != x["member"])), lambda x: x["x"]))


def _annual(facts: Column, context_of: Callable[[Column], Column]) -> Column:
    """Readable facts of annual contexts: (axis, member, start, end, value)."""
    held = F.filter(F.transform(facts, lambda f: F.struct(context_of(f[2]).alias("c"), f.alias("f"))),
                    lambda x: F.datediff(x["c"]["end"], x["c"]["start"]).between(MIN_DAYS, MAX_DAYS))
    return F.filter(F.transform(held, lambda x: F.struct(
        *[x["c"][name].alias(name) for name in ("axis", "member", "start", "end")], _value(x["f"]).alias("value"))),
        lambda x: x["value"].isNotNull())


def _choose(rows: Column, first: Callable[[Column], Column]) -> Column:
    """Newest period end, first axis with data, first fact of a member."""
    def on_axis(newest: Column, axis: str) -> Column:
        return F.filter(newest, lambda x: x["axis"] == axis)

    newest = let(rows, lambda all_: let(F.array_max(F.transform(all_, lambda x: x["end"])), lambda end: F.filter(
        all_, lambda x: x["end"] == end)))
    picked = let(newest, lambda n: let(on_axis(n, AXES[0]), lambda a: F.when(
        F.size(a) > 0, a).otherwise(on_axis(n, AXES[1]))))
    return let(picked, first)


def segment_entries(markup: Column, large: int = LARGE) -> Column:
    """The segments of a document: array of (axis, member, start, end, value).

    Annual facts of the newest period end, on the first axis with data, the
    first fact of a member; a context id used twice keeps its last definition.
    """
    def chosen(p: Column, found: Callable, first: Callable[[Column], Column]) -> Column:
        return _choose(found(p["contexts"], lambda context_of: _annual(p["facts"], context_of)), first)

    parsed = F.struct(_contexts(markup).alias("contexts"), _facts(markup).alias("facts"))
    few = lambda p: F.size(p["contexts"]).cast("bigint") * F.size(p["facts"]) <= large
    return let(parsed, lambda p: F.when(few(p), chosen(p, _scanned, _first_per_member))
               .otherwise(chosen(p, _bisected, _first_in_order)))


def unpack_segments(rows: DataFrame, entries: Column, keys: tuple[str, ...]) -> DataFrame:
    """(keys, axis, member, label, value, period_start, period_end)."""
    return (rows.select(*keys, F.explode(entries).alias("e"))
            .select(*keys, "e.axis", "e.member", pretty_member(F.col("e.member")).alias("label"), "e.value",
                    F.col("e.start").alias("period_start"), F.col("e.end").alias("period_end")))


def segment_revenue(docs: DataFrame, markup: str, keys: tuple[str, ...], large: int = LARGE) -> DataFrame:
    """Segment rows per document; documents without segments give none."""
    # Exploded as an expression: of an exploded column Spark would infer a filter
    # and push it below the extraction, which would then run twice.
    return unpack_segments(docs, segment_entries(F.col(markup), large), keys)


def ordered_segments(segments: DataFrame, *keys: str) -> DataFrame:
    """Largest segment first."""
    return segments.orderBy(*keys, F.col("value").desc(), "member")


def ranked_segments(segments: DataFrame, *keys: str) -> DataFrame:
    """The same order as a column: ``segment_rank`` is 1 on the largest segment of a document."""
    largest = Window.partitionBy(*keys).orderBy(F.col("value").desc(), "member")
    return segments.withColumn("segment_rank", F.row_number().over(largest).cast("bigint"))
