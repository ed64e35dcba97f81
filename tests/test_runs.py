"""The whole job: order of periods, idempotence, batches, documents, case updates."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curdline.operators import bundle, rollups, shared_events
from curdline.operators.baselines import baselines_for_period
from curdline.operators.month_stats import month_stats
from curdline.plans import screening
from curdline.schema import BUNDLE, BUNDLE_ITEM
from curdline.sources import tables


WINTER = [(2024, 10), (2024, 11), (2024, 12), (2025, 1)]


def winter(records, facility="Hillside", producers=5, dip=True):
    """Four months of six deliveries a week; each measure is its level plus or minus one step, by a bit of the day."""
    days = [d for d in range(1, 31) if d % 7]
    steps = {"qty": (55.0, 4.0), "fat_pct": (4.25, 0.0625), "snf_pct": (9.0, 0.03125), "clr": (30.0, 0.25)}
    rows = [
        {"facility": facility, "dcs": float(p), "society_name": f"Yard {p}", "serial_no": 100 * p + d, "shift": "M",
         "date": dt.date(y, m, d), "file_year": y, "file_month": m, "season": "winter"}
        | {name: level + (step if d >> bit & 1 else -step) for bit, (name, (level, step)) in enumerate(steps.items())}
        for y, m in WINTER for p in range(1, producers + 1) for d in days
    ]
    if dip:
        odd = next(r for r in rows if r["dcs"] == 2.0 and r["date"] == dt.date(2025, 1, 9))
        odd |= {"snf_pct": 7.5, "clr": 24.0}
    return records(rows)


def stored_rows(spark, state, name):
    """A stored table, with the columns that its files have."""
    folder = f"{state}/{name}"
    newest = tables.VersionedTable(spark, folder, StructType([]))
    whole = spark.read.parquet(f"{folder}/data").drop("batch").schema if newest.state()[1]["months"] else StructType([])
    return tables.read_table(spark, folder, whole)


def documents(spark, state):
    """Stored documents, put together with their lists."""
    items = tables.read_table(spark, f"{state}/bundle_items", BUNDLE_ITEM)
    heads = tables.read_table(spark, f"{state}/report_bundles", BUNDLE)
    rows = bundle.with_lists(heads, items).orderBy("facility", "file_year", "file_month").collect()
    docs = [json.loads(r["bundle_json"]) for r in rows]
    for row, doc in zip(rows, docs, strict=True):
        for name in bundle.LISTS[:-1]:
            items = [json.loads(x) for x in row["lists"].get(name, [])]
            assert doc[name] == {"list": name, "rows": len(items)}
            doc[name] = items
    return rows, docs


def test_incremental_runs(spark, records, tmp_path):
    state = str(tmp_path / "state")
    everything = winter(records)
    first = everything.where("file_month IN (10, 11)")
    assert {r["mode"] for r in screening.run_incremental(spark, first, state).collect()} == {"seed_only"}
    assert {r["period"] for r in screening.skipped_periods(spark, everything, state).collect()} == {
        "Hillside:2024-10", "Hillside:2024-11"}
    summary = {r["file_month"]: r for r in screening.run_incremental(spark, everything, state).collect()}
    assert {m: r["mode"] for m, r in summary.items()} == {12: "seed_only", 1: "detection"}
    assert summary[1]["final_flags"] == 1 and summary[1]["records_processed"] == 130

    rows, docs = documents(spark, state)
    assert [(r["file_month"], r["mode"]) for r in rows] == [(10, "seed_only"), (11, "seed_only"), (12, "seed_only"), (1, "detection")]
    assert [d["history_inputs"]["historical_month_stats_count"] for d in docs] == [0, 5, 10, 15]
    january = docs[3]
    assert len(january) == 15 and january["methodology_version"] == "screening-v1-safety"
    assert [r["diagnosis"] for r in january["report_records"]] == ["LOW_DENSITY_COMPOSITION_SCREEN"]
    assert january["report_records"][0]["date"] == "09-01-2025"
    assert len(january["current_month_stats"]) == 5 and len(january["sections"]["calibration"]["watchlist"]) == 5
    assert january["sections"]["executive_summary"]["top_findings"][0]["severity"] == "ISOLATED"
    assert docs[0]["sections"]["executive_summary"]["top_findings"][0]["deviation_score"] == 0.0
    assert "Calibration report for Hillside 2024-10" in docs[0]["retrieval"]["summary_text"]
    assert january["retrieval"]["top_diagnoses"] == {"LOW_DENSITY_COMPOSITION_SCREEN": 1}

    with pytest.raises(ValueError, match="No new reporting periods"):
        screening.run_incremental(spark, everything, state)
    assert len(documents(spark, state)[0]) == 4
    audit = stored_rows(spark, state, "audit_trail")
    assert audit.count() == 20 and audit.select("facility").distinct().count() == 1
    assert stored_rows(spark, state, "month_stats").count() == 20

    # One period at a time gives the same flags as all at once.
    whole = screening.screen(everything).collect()
    stats = month_stats(everything)
    single = [r for y, m in WINTER for r in screening.score(
        everything.where(f"file_month = {m}"), baselines_for_period(stats, y, m)).collect()]
    assert sorted(map(str, whole)) == sorted(map(str, single)) and len(whole) == 1

    case = screening.read_cases(spark, state).first()
    ddl = "case_id string, status string, disposition string, confirmation_reference string"
    screening.update_cases(spark, state, spark.createDataFrame([(case["case_id"], "confirmed", "ok", None)], ddl))
    stored = screening.read_cases(spark, state).collect()
    assert [(r["status"], r["disposition"]) for r in stored] == [("CONFIRMED", "ok")]


def test_batch_of_facilities(spark, records, tmp_path):
    state = str(tmp_path / "state")
    both = winter(records, "Hillside", 1, False).unionByName(winter(records, "Harbour", 1, False)).where("file_month = 10")
    screening.run_batch(spark, both, state)
    rows, docs = documents(spark, state)
    assert [(r["facility"], r["mode"]) for r in rows] == [("ALL", "seed_only")]
    assert docs[0]["file_identity"]["facilities"] == ["Harbour", "Hillside"]
    assert docs[0]["processing_metrics"]["facility_count"] == 2 and len(docs[0]["current_month_stats"]) == 2
    assert {r["facility"] for r in stored_rows(spark, state, "audit_trail").collect()} == {"ALL"}
    with pytest.raises(RuntimeError, match="already present"):
        screening.run_batch(spark, both, state)
    with pytest.raises(ValueError, match="No new reporting periods"):
        screening.run_incremental(spark, both, state)  # the ALL bundle completes the month for every facility
    screening.run_batch(spark, both, state, force=True)
    assert stored_rows(spark, state, "month_stats").count() == 2 and len(documents(spark, state)[0]) == 1


def test_forced_rerun_leaves_nothing_stale(spark, records, tmp_path):
    state = str(tmp_path / "state")
    both = winter(records).unionByName(winter(records, "Harbour", 2, False))
    screening.run_incremental(spark, both, state)
    # the corrected report lacks two producers and the odd delivery
    corrected = both.where("facility = 'Hillside' AND file_month = 1 AND dcs NOT IN (2, 3)")
    assert [(r["file_month"], r["final_flags"]) for r in screening.run_incremental(spark, corrected, state, force=True).collect()] == [(1, 0)]

    def stored(name):
        return stored_rows(spark, state, name).where("file_month = 1")

    assert {(r["facility"], r["dcs"]) for r in stored("month_stats").collect()} == {
        ("Hillside", 1.0), ("Hillside", 4.0), ("Hillside", 5.0), ("Harbour", 1.0), ("Harbour", 2.0)}
    assert tables.VersionedTable(spark, f"{state}/flagged", StructType([])).state()[1]["months"] == {}
    assert stored("daily_summary").where("facility = 'Hillside'").agg({"total_active": "max"}).first()[0] == 3
    rows, docs = documents(spark, state)
    assert len(rows) == 8
    january = next(d for r, d in zip(rows, docs, strict=True) if (r["facility"], r["file_month"]) == ("Hillside", 1))
    assert len(january["current_month_stats"]) == 3 and january["report_records"] == []
    # the earlier months are as they were
    assert stored_rows(spark, state, "month_stats").count() == 15 + 6 + 5


def test_heads_do_not_grow_with_their_lists(spark, records):
    """A period with many flags: the head names the lists and their sizes, every row is in the list table."""
    data = winter(records).cache()
    stats = month_stats(data).drop("processed_at").cache()
    baselines = baselines_for_period(stats, 2025, 1).cache()
    once = screening.score(data, baselines).cache()
    copies = 400
    flags = once.crossJoin(spark.range(copies).selectExpr("CAST(id + 1 AS INT) AS copy")).withColumn("serial_no", F.expr("serial_no * 1000 + copy")).drop("copy")
    counts = rollups.flag_counts(flags).cache()
    daily = shared_events.daily_summary(flags, shared_events.active_societies(data))
    items = bundle.list_items(stats, baselines, flags, counts, daily).cache()
    found = bundle.documents(data, stats, baselines, counts, rollups.history_counts(stats), items).where("file_month = 1").first()
    head = json.loads(found["bundle_json"])
    assert head["anomaly_records"] == {"list": "anomaly_records", "rows": copies}
    assert head["sections"]["detail_logs"]["rows"] == {"list": "detail_rows", "rows": copies}
    assert items.where("list = 'report_records' AND file_month = 1").count() == copies
    assert "serial_no" not in found["bundle_json"]
    first = bundle.top_findings(spark.createDataFrame([found], "facility string, file_year int, file_month int, mode string, bundle_json string"))
    assert [(r["rank"], r["dcs"], r["finding"]) for r in first.collect()] == [(1, 2.0, "VERY_FREQUENT")]
