"""Landings in any order, and silver and gold for the changed companies only."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import FIELDS, company
from tallyforge import schemas
from tallyforge.plans import medallion
from tallyforge.sources import tables
from tallyforge.streaming.ingest import apply_batch

LANDED = "ticker string, value string, file_path string, file_time int"


def document(ticker, factor):
    facts = {}
    for r in company(ticker):
        tag = facts.setdefault(r["taxonomy"], {}).setdefault(r["tag"], {"label": r["label"], "units": {}})
        tag["units"].setdefault(r["unit"], []).append(
            {"start": r["period_start"], "end": r["period_end"], "val": r["val"] * factor, "fy": r["fy"], "fp": r["fp"],
             "form": r["form"], "filed": r["filed"], "accn": r["accn"]})
    return json.dumps({"facts": facts})


LANDINGS = [("A", document("A", 1), "f1", 10), ("A", document("A", 2), "f2", 20), ("A", "{broken", "f3", 30),
            ("B", document("B", 3), "f1", 10), ("B", document("B", 4), "f0", 10)]


def facts(spark, table):
    return sorted(map(str, tables.read_table(spark, table, schemas.FACTS).collect()))


def test_any_order_of_landings_gives_one_result(spark, tmp_path):
    want = None
    splits = [[[0, 1, 2, 3, 4]], [[4], [3], [2], [1], [0]], [[1, 4], [0, 3], [2]], [[2, 0], [3], [1, 4]]]
    for n, split in enumerate(splits):
        table = str(tmp_path / f"t{n}")
        for batch in split:
            apply_batch(spark.createDataFrame([LANDINGS[i] for i in batch], LANDED), table, buckets=2)
        got = facts(spark, table)
        want = want or got
        assert got == want and len(got) == 2 * 3 * len(FIELDS)
    kept = {r.ticker: (r.file_time, r.file_path) for r in tables.read_table(spark, f"{table}-versions").collect()}
    assert kept == {"A": (20, "f2"), "B": (10, "f1")}


def test_an_older_file_is_no_change(spark, tmp_path):
    table = str(tmp_path / "t")
    apply_batch(spark.createDataFrame(LANDINGS[1:2], LANDED), table, buckets=2, run_id="one")
    apply_batch(spark.createDataFrame(LANDINGS[:1] + LANDINGS[3:4], LANDED), table, buckets=2, run_id="two")
    apply_batch(spark.createDataFrame(LANDINGS[:2], LANDED), table, buckets=2, run_id="three")
    assert sorted((r.run, r.ticker) for r in tables.read_table(spark, f"{table}-changes", schemas.CHANGES).collect()) == \
        [("one", "A"), ("two", "B")]


@pytest.fixture
def store(tmp_path):
    return medallion.Store(str(tmp_path / "lake"))


def land(spark, store, rows, run):
    apply_batch(spark.createDataFrame(rows, LANDED), store.path("bronze", "xbrl_facts"), buckets=4, run_id=run)


def content(spark, store):
    return {f"{layer}/{name}": sorted(map(str, tables.read_table(spark, store.path(layer, name), ddl).collect()))
            for layer, name, ddl in (("silver", "statements", schemas.STATEMENTS), ("silver", "statements_wide", schemas.WIDE),
                                     ("gold", "ratios", medallion.RATIO_SCHEMA), ("gold", "anomalies", schemas.ANOMALIES))}


def files(store):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.root}/silver/statements*/bucket=*/*.parquet")}


def test_refresh_equals_a_full_build(spark, store, tmp_path):
    tickers = [f"T{i}" for i in range(12)]
    land(spark, store, [(t, document(t, 1), "f1", 1) for t in tickers], "first")
    counts = medallion.build_silver(spark, store)
    assert counts["statements"] == len(tables.read_table(spark, store.path("silver", "statements")).collect()) > 0
    gold = medallion.build_gold(spark, store)
    assert gold["ratios"] == 36 and 0 <= gold["dupont_gap"] < 1e-9
    before = files(store)
    assert medallion.refresh(spark, store) == 12 and medallion.refresh(spark, store) == 0
    before = files(store)
    land(spark, store, [("T3", document("T3", 5), "f2", 2), ("NEW", document("NEW", 1), "f1", 2)], "second")
    assert medallion.refresh(spark, store) == 2
    after = files(store)
    kept = [f for f in before if after.get(f) == before[f]]
    changed = {f.split("bucket=")[1].split("/")[0] for f, _ in set(before.items()) ^ set(after.items())}
    assert kept and len(changed) <= 2
    mine = content(spark, store)
    full = medallion.Store(str(tmp_path / "full"))
    land(spark, full, [("T3", document("T3", 5), "f2", 2), ("NEW", document("NEW", 1), "f1", 2)]
         + [(t, document(t, 1), "f1", 1) for t in tickers], "all")
    medallion.build_silver(spark, full)
    medallion.build_gold(spark, full)
    assert mine == content(spark, full) and any("NEW" in r for r in mine["gold/ratios"])
    # A company whose document has no facts any more loses its rows.
    land(spark, store, [("T3", '{"facts": {}}', "f3", 3)], "third")
    assert medallion.refresh(spark, store) == 1
    assert {k: [r for r in v if "'T3'" not in r] for k, v in mine.items()} == content(spark, store)


def test_a_broken_identity_stops_the_run(spark, store, monkeypatch):
    land(spark, store, [("A", document("A", 1), "f1", 1)], "first")
    medallion.build_silver(spark, store)
    ratios = medallion.compute_ratios
    monkeypatch.setattr(medallion, "compute_ratios", lambda wide: ratios(wide).withColumn("roe", F.col("roe") + 1))
    with pytest.raises(ValueError):
        medallion.build_gold(spark, store)
