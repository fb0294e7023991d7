"""Raw documents to bronze, silver and gold tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import documents as docs_ops
from tallyforge.operators import registry
from tallyforge.operators.facts import ANNUAL, QUARTERLY, FormSpec
from tallyforge.operators.flags import red_flags
from tallyforge.operators.ratios import RATIO_SCHEMA, compute_ratios, dupont_metrics, with_prior_margin
from tallyforge.operators.statements import build_statements, to_wide
from tallyforge.session import checkpoint_root
from tallyforge.sources import landing
from tallyforge.sources.tables import (BUCKETS, drop_path, layout, metrics_of, observed, read_table, replace_by_key, row_counts, rows_of,
                                       staged, write_table)
from tallyforge.streaming.ingest import changes_path, record_changes


BRONZE = {"xbrl_facts": schemas.FACTS, "companies": schemas.COMPANIES,
          "company_profile": schemas.PROFILE, "filings": schemas.FILINGS,
          "mdna": schemas.MDNA, "segment_revenue": schemas.SEGMENTS}


@dataclass(frozen=True)
class Store:
    """Where the tables live."""

    root: str

    def path(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"


def ingest(spark: SparkSession, store: Store, landed: str, run_time: str,
           mdna_filings: int = 2, buckets: int | None = None,
           requested: DataFrame | None = None) -> DataFrame:
    """Landed folders (registry, facts, submissions, documents) to bronze.

    Every landed ticker is replaced in every table, also where it yields no
    rows any more, so no stale rows stay behind.  Facts and document results are
    written once and read back: documents are parsed in one pass.  A landed
    ticker that the registry does not know writes nothing.  Tickers of the work
    list (requested, and already ingested) that did not land or are unknown are
    listed in ``failures``; the counts of all tables in ``row_counts``.
    Returns the ingested tickers.
    """
    run = uuid.uuid4().hex

    def replace(rows: DataFrame, table: str) -> None:
        replace_by_key(rows, tickers, store.path("bronze", table), buckets=buckets,
                       ddl=BRONZE[table])

    entries = landing.registry(landing.read_documents(spark, f"{landed}/registry"))
    docs = landing.read_company_documents(spark, f"{landed}/facts")
    observed = staged(landing.facts_or_mark(docs), f"{run}-facts")
    looked_up = registry.lookup_tickers(observed.filter("readable").select("ticker").distinct(), entries)
    tickers = staged(looked_up.filter(F.col("cik").isNotNull()).select("ticker"), f"{run}-tickers")
    before = staged(read_table(spark, store.path("bronze", "companies"), schemas.COMPANIES).select("ticker"),
                    f"{run}-before")
    wanted = tickers.limit(0) if requested is None else requested.select("ticker").distinct()
    write_table(registry.failure_report(registry.work_list(wanted, before).union(registry.rejects(looked_up)),
                                        tickers, wanted), store.path("bronze", "failures"))
    replace(observed.filter("tag IS NOT NULL").drop("readable"), "xbrl_facts")
    facts = read_table(spark, store.path("bronze", "xbrl_facts"), schemas.FACTS) \
        .join(tickers, "ticker", "left_semi")
    stamped = tickers.withColumn("fetched_at", F.lit(run_time).cast("timestamp"))
    replace(landing.company_dimension(stamped, entries, facts), "companies")
    companies = read_table(spark, store.path("bronze", "companies"), schemas.COMPANIES) \
        .join(tickers, "ticker", "left_semi")
    subs = landing.parse_submissions(
        landing.read_company_documents(spark, f"{landed}/submissions")).drop("value")
    named = subs.join(companies.select("ticker", "cik", "entity_name"), "ticker")
    replace(landing.company_profile(named), "company_profile")
    replace(landing.filing_index(named), "filings")
    filings = read_table(spark, store.path("bronze", "filings"), schemas.FILINGS) \
        .join(tickers, "ticker", "left_semi")
    newest = staged(docs_ops.recent_filings(filings, mdna_filings), f"{run}-filings")
    markup = landing.read_filing_documents(spark, f"{landed}/documents/*/*")
    results = staged(docs_ops.document_results(docs_ops.filing_documents(newest, markup)),
                     f"{run}-documents")
    replace(docs_ops.mdna_of(results, newest), "mdna")
    replace(docs_ops.segments_of(results), "segment_revenue")
    write_table(row_counts({name: read_table(spark, store.path("bronze", name), ddl)
                            for name, ddl in BRONZE.items()}), store.path("bronze", "row_counts"))
    record_changes(tickers, store.path("bronze", "xbrl_facts"), run)
    for name in ("facts", "before", "filings", "documents"):
        drop_path(spark, f"{checkpoint_root(spark)}/staged/{run}-{name}")
    return companies.select("ticker")


def pending_changes(spark: SparkSession, store: Store) -> tuple[DataFrame, DataFrame]:
    """(runs, tickers) of ingestions that silver and gold do not show yet."""
    changes = read_table(spark, changes_path(store.path("bronze", "xbrl_facts")), schemas.CHANGES)
    applied = read_table(spark, store.path("gold", "applied_runs"), "run STRING")
    new = staged(changes.join(applied, "run", "left_anti").select("run", "ticker"), f"{uuid.uuid4().hex}-changes")
    return new.select("run").distinct(), new.select("ticker").distinct()


def refresh(spark: SparkSession, store: Store) -> int:
    """Bring silver and gold up to date; only the companies that changed are read and rebuilt.

    Returns how many there were.  Runs are marked last, so an interrupted
    refresh is done again.
    """
    runs, tickers = pending_changes(spark, store)
    n = tickers.count()
    if n:
        build_silver(spark, store, changed=tickers)
        build_gold(spark, store, changed=tickers)
        runs.coalesce(1).write.mode("append").parquet(store.path("gold", "applied_runs"))
    return n


def _source(spark: SparkSession, store: Store, layer: str, table: str, ddl: str, changed: DataFrame | None) -> DataFrame:
    path = store.path(layer, table)
    return read_table(spark, path, ddl) if changed is None else rows_of(spark, path, changed, ddl)


def _put(rows: DataFrame, path: str, ddl: str, changed: DataFrame | None, buckets: int,
         metrics: dict[str, Column] | None = None) -> dict:
    """Write a table laid out by company, or its changed companies only; what was observed on the way."""
    rows, seen = observed(rows, metrics)
    if changed is None:
        write_table(rows, path, "ticker", buckets)
    else:
        name = f"{uuid.uuid4().hex}-rows"
        new = layout(rows.sparkSession, path) is None
        replace_by_key(staged(rows, name), changed, path, ddl=ddl, buckets=buckets if new else None)
        drop_path(rows.sparkSession, f"{checkpoint_root(rows.sparkSession)}/staged/{name}")
    return metrics_of(seen)


def _buckets(spark: SparkSession, store: Store) -> int:
    """Silver and gold follow the layout of the facts."""
    stored = layout(spark, store.path("bronze", "xbrl_facts"))
    return stored[1] if stored else BUCKETS


def build_silver(spark: SparkSession, store: Store, annual: FormSpec = ANNUAL, quarterly: FormSpec = QUARTERLY,
                 changed: DataFrame | None = None) -> dict[str, int]:
    """Statements of both forms in one pass over the facts, then the wide tables and the chunks.

    With ``changed`` only these companies are read and replaced.  Returns the
    rows written per table, as observed by the writes.
    """
    buckets = _buckets(spark, store)
    facts = _source(spark, store, "bronze", "xbrl_facts", schemas.FACTS, changed)
    counts = {"statements": _put(build_statements(facts, [annual, quarterly]), store.path("silver", "statements"),
                                 schemas.STATEMENTS, changed, buckets)}
    tidy = _source(spark, store, "silver", "statements", schemas.STATEMENTS, changed)
    for name, form in (("statements_wide", annual.form), ("statements_wide_q", quarterly.form)):
        counts[name] = _put(to_wide(tidy.filter(F.col("form") == form)), store.path("silver", name), schemas.WIDE, changed,
                            buckets)
    mdna = _source(spark, store, "bronze", "mdna", schemas.MDNA, changed)
    counts["mdna_chunks"] = _put(docs_ops.chunk_table(mdna), store.path("silver", "mdna_chunks"), schemas.CHUNKS, changed,
                                 buckets)
    return {name: seen["n_rows"] for name, seen in counts.items()}


def statements(spark: SparkSession, store: Store, form: str = "10-K") -> DataFrame:
    return read_table(spark, store.path("silver", "statements"), schemas.STATEMENTS).filter(F.col("form") == form)


def build_gold(spark: SparkSession, store: Store, changed: DataFrame | None = None) -> dict:
    """Ratios, then the flags; returns rows per table and the largest DuPont gap, as observed by the writes.

    A DuPont product that is not ROE stops the run before the flags.
    """
    buckets = _buckets(spark, store)
    wide = _source(spark, store, "silver", "statements_wide", schemas.WIDE, changed)
    audit = _put(compute_ratios(wide), store.path("gold", "ratios"), RATIO_SCHEMA, changed, buckets, dupont_metrics())
    if audit.get("dupont_ok") is False:
        raise ValueError("DuPont factors do not multiply to ROE")
    ratios = _source(spark, store, "gold", "ratios", RATIO_SCHEMA, changed)
    flags = _put(red_flags(with_prior_margin(ratios)), store.path("gold", "anomalies"), schemas.ANOMALIES, changed, buckets)
    return {"ratios": audit["n_rows"], "anomalies": flags["n_rows"], "dupont_gap": audit.get("dupont_gap")}
