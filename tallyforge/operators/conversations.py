"""Jobs over a table of conversation turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import strip

# Served function names and leaked template tokens.
FUNCTION_NAMES = ["get_statements", "get_ratios", "get_anomalies", "list_companies",
                  "ingest_company", "get_pipeline_status", "search_mdna"]
_NARRATED = r"(?:" + "|".join(FUNCTION_NAMES) + r")\s*\(|/ipython|<\|python_tag\|>|<\|eom\|>"
CONTEXT_TURNS = 6

CALLS = "array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>"


def narrates_calls(text: Column) -> Column:
    """True if the text writes a function call instead of making it."""
    return F.coalesce(text, F.lit("")).rlike(_NARRATED)


def pseudo_call_turns(turns: DataFrame) -> DataFrame:
    return turns.filter((F.col("role") == "assistant") & narrates_calls(F.col("text")))


def usable_context(turns: DataFrame, last: int = CONTEXT_TURNS) -> DataFrame:
    """The turns before the newest one, cut to ``last`` and then cleaned.

    Only user and assistant turns count.  The cut comes first, so a dropped turn
    is not replaced by an older one.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    ranked = (turns.filter(F.col("role").isin("user", "assistant"))
              .withColumn("_rn", F.row_number().over(newest))
              .filter(F.col("_rn") <= last + 1))
    noise = (F.col("role") == "assistant") & narrates_calls(F.col("text"))
    return ranked.filter((F.col("_rn") > 1) & ~noise).drop("_rn")


def content_text(content: Column) -> Column:
    """Message content (a variant: a string, or a list of parts) -> text.

    A string stays as it is, also one that looks like JSON.  Of a list, bare
    strings and parts of type text or output_text (or without a type) are kept
    and joined with a newline.  Anything else is its JSON text.
    """
    parsed = content
    kind = F.schema_of_variant(parsed)
    parts = F.transform(F.variant_get(parsed, "$", "array<variant>"), lambda p: F.when(
        F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).when(
        F.coalesce(F.try_variant_get(p, "$.type", "string"), F.lit("text"))
        .isin("text", "output_text")
        & (F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING"),
        F.try_variant_get(p, "$.text", "string")))
    joined = strip(F.array_join(F.filter(parts, lambda t: t.isNotNull() & (t != "")), "\n"))
    return (F.when(content.isNull(), "")
            .when(kind.startswith("ARRAY"), joined)
            .when(kind == "STRING", F.try_variant_get(parsed, "$", "string"))
            .otherwise(F.to_json(content)))


def tool_calls(turns: DataFrame) -> DataFrame:
    """One row per call: (conv_id, turn, pos, call_id, name, arguments map); null arguments are unreadable."""
    calls = turns.filter(F.col("tool_calls").isNotNull()).select(
        "conv_id", "turn", F.posexplode(F.from_json("tool_calls", CALLS)).alias("pos", "c"))
    written = F.coalesce(F.nullif(F.col("c.function.arguments"), F.lit("")), F.lit("{}"))
    arguments = F.from_json(written, "map<string, string>")
    return calls.select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"),
        F.col("c.id").alias("call_id"), F.col("c.function.name").alias("name"),
        arguments.alias("arguments"))


def audit_trail(turns: DataFrame) -> DataFrame:
    """Every call with its arguments and result; unreadable arguments are empty.

    Calls and results of one id are matched by their places in the
    conversation: the results that follow the calls of a turn, before the next
    turn with calls, answer these calls in their order.  An id that is used again, and a result that comes
    twice or too early, repeat no call.  ``status`` tells how a call went: ``ok``,
    ``error`` (its result is a JSON object with an ``error``), ``unanswered``, or
    ``unreadable`` (its arguments are no JSON object).  The matching is by windows
    over (conversation, id), so a long conversation is spread.
    """
    calls = tool_calls(turns).select(
        "conv_id", "call_id", F.struct("turn", "pos").alias("at"), F.lit(True).alias("is_call"),
        F.struct("turn", "pos", "name", "arguments").alias("call"), F.lit(None).cast("string").alias("result"))
    results = turns.filter((F.col("role") == "tool") & F.col("tool_call_id").isNotNull()).select(
        "conv_id", F.col("tool_call_id").alias("call_id"),
        # A result in the turn of a call follows it.
        F.struct("turn", F.lit(2**31).cast("bigint").alias("pos")).alias("at"), F.lit(False).alias("is_call"),
        F.lit(None).cast(calls.schema["call"].dataType).alias("call"),
        F.coalesce(F.nullif("text", F.lit("")), F.lit("[]")).alias("result"))
    by_place = Window.partitionBy("conv_id", "call_id").orderBy("at")
    before = F.lag(F.when(F.col("is_call"), F.col("at.turn"))).over(by_place)
    starts = F.col("is_call") & ~F.coalesce(before == F.col("at.turn"), F.lit(False))
    rounds = (calls.unionByName(results).withColumn("_starts", starts.cast("int"))
              .withColumn("_round", F.sum("_starts").over(by_place.rowsBetween(Window.unboundedPreceding, 0))))
    nth = Window.partitionBy("conv_id", "call_id", "_round", "is_call").orderBy("at")
    met = (rounds.withColumn("_nth", F.row_number().over(nth)).groupBy("conv_id", "call_id", "_round", "_nth")
           .agg(F.first("call", True).alias("call"), F.first("result", True).alias("result")).filter(F.col("call").isNotNull()))
    failed = F.try_variant_get(F.try_parse_json("result"), "$.error", "string").isNotNull()
    return met.select(
        "conv_id", "call.turn", "call.pos", "call_id", "call.name",
        F.coalesce("call.arguments", F.create_map().cast("map<string, string>")).alias("arguments"), "result",
        F.when(F.col("result").isNull(), "unanswered").when(failed, "error")
        .when(F.col("call.arguments").isNull(), "unreadable").otherwise("ok").alias("status"))


def conversation_summary(turns: DataFrame) -> DataFrame:
    """Tool results and the last ticker asked for, per conversation, in one pass."""
    calls = F.from_json("tool_calls", CALLS)
    rows = turns.select("conv_id", "turn", "role", F.posexplode_outer(calls).alias("pos", "c"))
    ticker = F.upper(strip(F.from_json(F.col("c.function.arguments"),
                                        "map<string, string>")["p_ticker"]))
    rows = rows.select("conv_id", "role", F.nullif(ticker, F.lit("")).alias("ticker"),
                       F.struct("turn", "pos").alias("at"))
    return rows.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "tool").alias("n_tool_calls"),
        F.max_by("ticker", F.when(F.col("ticker").isNotNull(), F.col("at")))
        .alias("focus_ticker"))
