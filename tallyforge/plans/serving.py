"""Results as SQL functions that return JSON, and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalar import metrics_json
from tallyforge.operators.documents import EXCERPT_CHARS, TOP_PASSAGES
from tallyforge.operators.ratios import RATIO_COLUMNS, RATIO_SCHEMA

# Function names and the order of their parameters.
PARAMETERS = {
    "list_companies": [],
    "get_statements": ["p_ticker", "p_statement"],
    "get_ratios": ["p_ticker"],
    "get_anomalies": ["p_ticker"],
    "search_mdna": ["p_ticker", "p_query"],
}

#: The words of a query, blanks between them left out.
_ASKED = "array_remove(split(lower(p_query), ' '), '')"

_BODIES = {
    "list_companies": """
        SELECT to_json(array_sort(collect_list(struct(ticker, cik, entity_name))))
        FROM tallyforge_companies""",
    "get_statements": """
        SELECT to_json(array_sort(collect_list(struct(line_item, period_end, value, tag_used))))
        FROM tallyforge_statements
        WHERE ticker = upper(p_ticker) AND statement = upper(p_statement)""",
    "get_ratios": f"""
        SELECT to_json(array_sort(collect_list(struct(ticker, period_end, {", ".join(RATIO_COLUMNS)}))))
        FROM tallyforge_ratios WHERE ticker = upper(p_ticker)""",
    "get_anomalies": """
        SELECT to_json(array_sort(collect_list(
               struct(period_end, rule_id, severity, explanation, metrics))))
        FROM tallyforge_anomalies WHERE ticker = upper(p_ticker)""",
    "search_mdna": f"""
        SELECT to_json(transform(array_sort(collect_list(best)), b -> b.shown))
        FROM (SELECT struct(-hits AS fewer, datediff(DATE'9999-12-31', filing_date) AS age, chunk_id,
                            struct(filing_date, hits AS score,
                                   left(chunk_text, {EXCERPT_CHARS}) AS excerpt) AS shown) AS best
              FROM (SELECT *, cardinality(filter({_ASKED}, word -> instr(lower(chunk_text), word) > 0)) AS hits
                    FROM tallyforge_chunks WHERE ticker = upper(p_ticker))
              WHERE hits > 0 ORDER BY hits DESC, filing_date DESC, chunk_id LIMIT {TOP_PASSAGES})""",
}


#: Rows of the table functions: parameters, columns, body.
_TABLES = {
    "company_rows": ([], "ticker STRING, cik BIGINT, entity_name STRING",
                     "SELECT ticker, cik, entity_name FROM tallyforge_companies"),
    "statement_rows": (["p_ticker", "p_statement"],
                       "line_item STRING, period_end DATE, value DOUBLE, tag_used STRING",
                       """SELECT line_item, period_end, value, tag_used FROM tallyforge_statements
                          WHERE ticker = upper(p_ticker) AND statement = upper(p_statement)"""),
    "ratio_rows": (["p_ticker"], RATIO_SCHEMA,
                   f"""SELECT ticker, period_end, {", ".join(RATIO_COLUMNS)} FROM tallyforge_ratios
                       WHERE ticker = upper(p_ticker)"""),
    "anomaly_rows": (["p_ticker"],
                     "period_end DATE, rule_id STRING, severity STRING, explanation STRING, metrics STRING",
                     """SELECT period_end, rule_id, severity, explanation, metrics FROM tallyforge_anomalies
                        WHERE ticker = upper(p_ticker)"""),
}
#: The table function behind each function that a request may name.
ROWS_OF = {"list_companies": "company_rows", "get_statements": "statement_rows", "get_ratios": "ratio_rows",
           "get_anomalies": "anomaly_rows"}
REQUESTS = "request_id, name, p_ticker, p_statement"


def register_functions(spark: SparkSession, companies: DataFrame, statements: DataFrame,
                       ratios: DataFrame, anomalies: DataFrame, chunks: DataFrame) -> None:
    """Create the five functions for this session over the given tables."""
    companies.createOrReplaceTempView("tallyforge_companies")
    statements.createOrReplaceTempView("tallyforge_statements")
    ratios.createOrReplaceTempView("tallyforge_ratios")
    anomalies.withColumn("metrics", metrics_json(F.col("metrics"))) \
        .createOrReplaceTempView("tallyforge_anomalies")
    chunks.createOrReplaceTempView("tallyforge_chunks")
    for name, parameters in PARAMETERS.items():
        signature = ", ".join(f"{p} STRING" for p in parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) "
                  f"RETURNS STRING RETURN ({_BODIES[name]})")


    for name, (parameters, columns, body) in _TABLES.items():
        signature = ", ".join(f"{p} STRING" for p in parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS TABLE({columns}) RETURN {body}")


def call_requests(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """(request_id, name, status, n_rows, result) of a table of calls by name.

    Each known name is one lateral call of its table function over all its
    requests, which Spark plans as a join.  A request for an unknown function is
    a row with an error object, not an error; nothing found is an empty list.
    The rows of a request are those of one company.
    """
    requests.selectExpr(*REQUESTS.split(", ")).createOrReplaceTempView("tallyforge_requests")
    found = None
    for name, rows in ROWS_OF.items():
        arguments = ", ".join(f"r.{p}" for p in _TABLES[rows][0])
        part = spark.sql(f"""SELECT r.request_id, to_json(struct(t.*)) AS item FROM tallyforge_requests r,
                             LATERAL {rows}({arguments}) t WHERE r.name = '{name}'""")
        found = part if found is None else found.unionByName(part)
    lists = found.groupBy("request_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    known = F.coalesce(F.col("name").isin(list(ROWS_OF)), F.lit(False))
    failure = F.to_json(F.struct(F.concat(F.lit("Unknown function: "), F.coalesce("name", F.lit(""))).alias("error")))
    listed = F.concat(F.lit("["), F.array_join(F.coalesce("items", F.array().cast("array<string>")), ","), F.lit("]"))
    return requests.join(lists, "request_id", "left").select(
        "request_id", "name", F.when(known, "ok").otherwise("error").alias("status"),
        F.when(known, F.coalesce(F.size("items"), F.lit(0))).cast("bigint").alias("n_rows"),
        F.when(known, listed).otherwise(failure).alias("result"))


def call(spark: SparkSession, name: str, args: dict[str, str] | None = None) -> DataFrame:
    """One-row result of a function call; arguments are bound, never spliced into SQL."""
    if name not in PARAMETERS:
        raise KeyError(f"Unknown function: {name}")
    given = args or {}
    bound = {p: str(given.get(p, "")) for p in PARAMETERS[name]}
    markers = ", ".join(f":{p}" for p in PARAMETERS[name])
    return spark.sql(f"SELECT coalesce({name}({markers}), '[]') AS result", args=bound)


def json_per_key(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Batch form: the JSON array of every key at once.

    For tables with a bounded number of rows per key (statements, ratios, flags).
    """
    items = F.array_sort(F.collect_list(F.struct(*columns)))
    return rows.groupBy(*keys).agg(F.to_json(items).alias("result"))


def statements_json(statements: DataFrame) -> DataFrame:
    return json_per_key(statements, ["ticker", "statement"],
                        ["line_item", "period_end", "value", "tag_used"])


def ratios_json(ratios: DataFrame) -> DataFrame:
    return json_per_key(ratios, ["ticker"], ["ticker", "period_end", *RATIO_COLUMNS])


def anomalies_json(flags: DataFrame) -> DataFrame:
    return json_per_key(flags.withColumn("metrics", metrics_json(F.col("metrics"))), ["ticker"],
                        ["period_end", "rule_id", "severity", "explanation", "metrics"])
