"""Scalar expressions: safe arithmetic, labels and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import strip

MISSING = "—"


def change(cur: Column, base: Column) -> Column:
    """(cur - base) / |base|; null where the base is zero or missing."""
    return F.try_divide(cur - base, F.abs(base))


def change_sql(cur: str, base: str) -> str:
    """SQL of ``change`` for wide projections."""
    return f"try_divide({cur} - {base}, abs({base}))"


def sum_min_one(a: str, b: str) -> str:
    """SQL of a + b with a missing side as zero; null only if both are missing."""
    return f"coalesce({a} + {b}, {a}, {b})"


def money_label(v: Column) -> Column:
    """Dollar amount in T / B / M / K with one decimal, whole dollars below 1,000."""
    size = F.abs(v)
    label = F.when(v.isNull() | F.isnan(v), F.lit(MISSING))
    for unit, suffix in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        label = label.when(size >= unit,
                           F.concat(F.lit("$"), F.format_number(v / F.lit(unit), 1), F.lit(suffix)))
    return label.otherwise(F.concat(F.lit("$"), F.format_number(v, 0)))


def fiscal_label(period_end: Column) -> Column:
    return F.concat(F.lit("FY"), F.substring(period_end.cast("string"), 1, 4))


def percent_label(v: Column) -> Column:
    """Signed percentage with one decimal."""
    shown = F.call_function("format_number", v * 100, F.lit("+0.0;-0.0"))
    return F.coalesce(F.concat(shown, F.lit("%")), F.lit(MISSING))


def change_label(cur: Column, base: Column) -> Column:
    return percent_label(change(cur, base))


def cik10(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def compact_accession(accession: Column) -> Column:
    return F.replace(accession, F.lit("-"), F.lit(""))


def document_path(cik: Column, accession: Column, document: Column) -> Column:
    """Folder layout of landed filing documents: cik / accession / document."""
    return F.concat_ws("/", cik.cast("string"), compact_accession(accession), document)


def normal_ticker(c: Column) -> Column:
    return F.upper(strip(c))


def valid_ticker(c: Column) -> Column:
    """Letters and digits of any alphabet, at least one."""
    return F.coalesce(c.rlike(r"^[\p{L}\p{N}]+\z"), F.lit(False))


def strip_state_suffix(name: Column) -> Column:
    """'ACME CORP /DE/' -> 'ACME CORP'."""
    return F.trim(F.regexp_replace(name, "/[A-Z]{2}/?$", ""))


def escape_dollar(text: Column) -> Column:
    return F.replace(text, F.lit("$"), F.lit("\\$"))


def key_list(text: Column) -> Column:
    """Comma list -> array of trimmed, upper-cased, non-empty keys."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.upper(strip(x))),
                    lambda x: x != "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def code_text(c: Column, width: int | None = None) -> Column:
    """A code that was read as a number goes back to text: '6199.0' -> '6199'."""
    text = F.regexp_replace(c.cast("string"), r"\.0$", "")
    if width is None:
        return text
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def metrics_json(metrics: Column) -> Column:
    """Metric map -> JSON with four decimals and explicit nulls."""
    rounded = F.transform_values(metrics, lambda _, v: F.round(v, 4))
    return F.to_json(rounded, {"ignoreNullFields": "false"})
