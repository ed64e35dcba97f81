"""Rules, shared events and roll-ups on the literal cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from curdline.operators import cases, merge, rollups, rules, shared_events
from curdline.schema import RULES

FLAG_DDL = (
    "facility string, serial_no int, dcs double, society_name string, date date, shift string, file_year int, "
    "file_month int, qty double, z_snf double, z_fat double, z_clr double, diagnosis string, confidence string, "
    "seasonal_likely int, low_seasonal_data int, explanation string"
)
FLAG_DEFAULTS = {
    "facility": "F", "serial_no": 1, "dcs": 101.0, "society_name": "S", "date": dt.date(2026, 4, 1), "shift": "M",
    "file_year": 2026, "file_month": 4, "qty": 100.0, "z_snf": 0.0, "z_fat": 0.0, "z_clr": 0.0,
    "diagnosis": "LOW_FAT_SCREEN", "confidence": "REVIEW", "seasonal_likely": 0, "low_seasonal_data": 0,
    "explanation": "Text.",
}


@pytest.fixture(scope="module")
def flags(spark):
    names = [part.split()[0] for part in FLAG_DDL.split(", ")]
    return lambda rows: spark.createDataFrame([tuple({**FLAG_DEFAULTS, **r}[n] for n in names) for r in rows], FLAG_DDL)


def day(d, month=4, year=2025):
    return dt.date(year, month, d)


def test_seasonal_baseline_before_all_year(records, baselines):
    r = records([{"date": day(1, 1, 2026), "file_month": 1, "season": "winter", "snf_pct": 8.0, "clr": 26.0}])
    b = baselines([{"season": "winter", "record_count": 15, "snf_pct_mean": 8.0, "snf_pct_std": 0.1, "clr_mean": 26.0, "clr_std": 0.2}])
    assert rules.score_records(r, b).count() == 1 and rules.apply_rules(r, b).isEmpty()


def test_fallback_to_all_year(records, baselines):
    r = records([{"date": day(1, 1, 2026), "file_month": 1, "season": "winter", "snf_pct": 7.2, "clr": 24.0}])
    thin = {"season": "winter", "record_count": 10}
    whole = {"season": "all", "record_count": 31, "snf_pct_mean": 8.8, "clr_mean": 28.0}
    row = rules.apply_rules(r, baselines([thin, whole])).first()
    assert (row["low_seasonal_data"], row["R1_snf_drop"], row["R7_clr_drop"]) == (1, 1, 1)
    refused = baselines([thin, whole]).withColumn("eligible", F.lit(0))
    assert rules.score_records(r, refused).isEmpty()
    assert rules.score_records(r, baselines([thin, {**whole, "record_count": 29}])).isEmpty()


def test_rules_and_thin_baselines(records, baselines):
    rows = [{"serial_no": 1, "clr": 29.5}, {"serial_no": 2, "clr": 24.5}, {"serial_no": 3, "clr": 29.0}, {"serial_no": 4, "clr": 28.8},
            {"serial_no": 5, "snf_pct": 9.06, "fat_pct": 4.25}, {"serial_no": 6, "qty": 84.0, "fat_pct": 4.0}]
    got = {r["serial_no"]: r for r in rules.score_records(records(rows), baselines([{}])).collect()}
    fired = {n: {k for k, c in RULES.items() if r[c]} for n, r in got.items()}
    # clr 29.0 is exactly 2 deviations up: R5 needs more than 2; 24.5 is far down: R7.
    assert fired == {1: {"R5"}, 2: {"R7"}, 3: set(), 4: set(), 5: {"R4"}, 6: {"R6"}}
    classified = rules.diagnose(rules.suppress_thin(rules.score_records(records(rows), baselines([{}])))).collect()
    assert {r["serial_no"]: r["case"] for r in classified} == {1: "S5", 2: "S7", 3: "S0", 4: "S0", 5: "S4", 6: "S6"}
    few = baselines([{"record_count": 20}])
    kept = {r["serial_no"] for r in rules.apply_rules(records([*rows, {"serial_no": 7, "clr": 29.45}, {"serial_no": 8, "clr": 29.7}]), few).collect()}
    assert kept == {2, 8}  # only |z| > 3.5 of snf, fat or clr


def test_r3_is_relative_and_null_std_scores_zero(records, baselines):
    assert rules.apply_rules(records([{"fat_pct": 2.9}]), baselines([{"fat_pct_mean": 3.3, "fat_pct_std": 0.1}])).isEmpty()
    row = rules.apply_rules(records([{"fat_pct": 3.8}]), baselines([{"fat_pct_mean": 6.0}])).first()
    assert row["R3_fat_drop"] == 1
    flat = rules.score_records(records([{"fat_pct": 1.0, "snf_pct": None}]), baselines([{"fat_pct_std": None, "clr_std": 0.0}])).first()
    assert (flat["z_fat"], flat["z_clr"], flat["z_snf"], flat["R1_snf_drop"]) == (0.0, 0.0, None, 0)
    five = [{"snf_pct": 9.1, "serial_no": i} for i in range(5)]
    assert rules.apply_rules(records(five), baselines([{"snf_pct_mean": 8.8, "snf_pct_std": 1.0}])).isEmpty()


@pytest.mark.parametrize(("fired", "expected"), [
    (["R1", "R7"], ("LOW_DENSITY_COMPOSITION_SCREEN", "RESAMPLE", "S1_7")),
    (["R2", "R5"], ("HIGH_DENSITY_COMPOSITION_SCREEN", "RESAMPLE", "S2_5")),
    (["R1", "R7", "R6"], ("VOLUME_COMPOSITION_SHIFT", "RESAMPLE", "S6")),
    (["R5"], ("HIGH_DENSITY_SCREEN", "REVIEW", "S5")),
    (["R3", "R1"], ("LOW_FAT_SCREEN", "REVIEW", "S3")),
    (["R8"], ("LEGACY_RULE_DISABLED", "MONITOR", "S_LEGACY")),
    ([], ("UNCLASSIFIED_SCREENING_SIGNAL", "MONITOR", "S0")),
])
def test_category_precedence(spark, fired, expected):
    df = spark.range(1).select(*[F.lit(int(r in fired)).alias(c) for r, c in RULES.items()])
    r = rules.diagnose(df).first()
    assert (r["diagnosis"], r["confidence"], r["case"]) == expected


def test_priority_adjustment(flags):
    rows = [{"serial_no": 1, "qty": 9.0, "confidence": "RESAMPLE", "low_seasonal_data": 1}, {"serial_no": 2, "qty": 9.0, "confidence": "MONITOR"},
            {"serial_no": 3, "confidence": "RESAMPLE", "low_seasonal_data": 1}, {"serial_no": 4, "qty": None}, {"serial_no": 5, "qty": 1.0, "confidence": "OTHER"}]
    got = {r["serial_no"]: r for r in rules.adjust_priority(flags(rows)).collect()}
    assert [got[i]["confidence"] for i in range(1, 6)] == ["REVIEW", "MONITOR", "REVIEW", "REVIEW", "OTHER"]
    assert got[1]["confidence_base"] == "RESAMPLE" and got[4]["confidence_note"] == "" and got[4]["explanation"] == "Text."
    assert got[3]["explanation"] == "Text. Note: screening priority capped because same-season history is thin."


def test_shared_event_share_is_of_active_producers(records, flags):
    """Of eight producers three move down (an event), two up (none); one flag belongs to a shift without records."""
    when = {"facility": "F", "file_year": 2026, "file_month": 4}
    everyone = records([{**when, "dcs": float(d), "date": day(1, 4, 2026)} for d in range(21, 29)] * 2)
    moved = flags(
        [{"dcs": d, "z_snf": -1.75} for d in (21.0, 22.0)] + [{"dcs": 23.0, "z_fat": -1.25}]
        + [{"dcs": d, "z_clr": 1.5} for d in (24.0, 25.0)] + [{"dcs": 26.0, "shift": "E", "z_clr": 1.5}]
    ).drop("seasonal_likely")
    got = shared_events.mark_shared_events(moved, everyone).collect()
    assert {(r["shift"], r["direction"], r["pct_flagged"], r["seasonal_likely"]) for r in got} == {
        ("M", "down", 37.5, 1), ("M", "up", 25.0, 0), ("E", "up", None, 0)}
    daily = shared_events.daily_summary(moved, shared_events.active_societies(everyone)).collect()
    assert [(r["num_flagged"], r["pct_flagged"], r["seasonal_event"]) for r in daily] == [(5, 62.5, 1)]


def test_daily_summary_keeps_quiet_shifts(records, flags):
    everyone = records([{"dcs": 1.0}, {"dcs": 1.0}, {"shift": "E"}])
    none = flags([{}]).where("false")
    got = shared_events.daily_summary(none, shared_events.active_societies(everyone)).collect()
    assert [(r["total_active"], r["num_flagged"], r["seasonal_event"]) for r in got] == [(1, 0, 0)] * 2


def test_recurrence(flags):
    report = flags([{"confidence": "REVIEW"}, {"date": day(2, 4, 2026), "confidence": "RESAMPLE"}, {"dcs": 7.0},
                    {"society_name": None, "confidence": "MONITOR"}, {"society_name": None, "confidence": "MONITOR"}])
    got = rollups.in_recurrence_order(rollups.recurring_indicators(rollups.flag_counts(report))).collect()
    assert [(r["society_name"], r["screening_signal_count"], r["highest_priority"]) for r in got] == [(None, 2, "MONITOR"), ("S", 2, "RESAMPLE")]
    assert (got[1]["first_signal_date"], got[1]["last_signal_date"]) == (day(1, 4, 2026), day(2, 4, 2026))
    assert got[0]["indicator"] == "RECURRING_SCREENING_PATTERN" and "adulter" not in got[0]["interpretation"]


def test_severity_levels_cutoff_and_mode(flags):
    rows = [{"file_month": m, "dcs": float(n), "serial_no": i, "diagnosis": "B" if i % 2 else "A"}
            for m, n in [(1, 5), (2, 7), (3, 8), (4, 15), (5, 30), (6, 1), (7, 1)] for i in range(n)]
    counts = rollups.flag_counts(flags(rows)).cache()
    got = {r["file_month"]: (r["flags"], r["severity"], r["primary_diagnosis"]) for r in rollups.severity(counts).collect()}
    assert got == {2: (7, "ISOLATED", "A"), 3: (8, "RECURRING", "A"), 4: (15, "FREQUENT", "A"), 5: (30, "VERY_FREQUENT", "A"),
                   6: (1, "ISOLATED", "A"), 7: (1, "ISOLATED", "A")}
    assert rollups.severity(counts, None).count() == 7
    assert rollups.severity(rollups.flag_counts(flags(rows).where("file_month <= 2"))).count() == 2


def test_month_summary_with_and_without_flags(records, flags):
    everyone = records([{"facility": "F", "dcs": float(d), "file_year": 2026, "file_month": m} for d in range(1, 8) for m in (3, 4)])
    rows = [{"dcs": float(d), "serial_no": i, "confidence": "RESAMPLE"} for d in range(1, 8) for i in range(d)] + [{"seasonal_likely": 1}]
    got = {r["file_month"]: r for r in rollups.month_summaries(everyone, rollups.flag_counts(flags(rows))).collect()}
    assert (got[3]["mode"], got[3]["initial_flags"], got[3]["top_flagged_societies"], got[3]["top_diagnosis"]) == ("seed_only", 0, [], "")
    april = got[4]
    assert (april["records_processed"], april["societies_active"], april["initial_flags"], april["seasonal_suppressed"]) == (7, 7, 29, 1)
    assert april["high_confidence_flags"] == april["priority_resample_flags"] == april["final_flags"] == 28
    assert [(s["dcs"], s["flags"]) for s in april["top_flagged_societies"]] == [(7.0, 7), (6.0, 6), (5.0, 5), (4.0, 4), (3.0, 3)]


def test_detail_rows_drop_weak_unclassified(flags):
    weak = {"diagnosis": "UNCLASSIFIED_SCREENING_SIGNAL", "confidence": "MONITOR"}
    rows = [{**weak, "serial_no": 1, "z_snf": 1.5}, {**weak, "serial_no": 2, "z_snf": -1.6}, {"serial_no": 3}]
    assert {r["serial_no"] for r in rollups.detail_rows(flags(rows)).collect()} == {2, 3}


def test_case_identity_merge_listing_and_updates(spark, flags):
    made = cases.review_cases(flags([{"serial_no": 1}, {"serial_no": 2}, {"serial_no": 1, "confidence": "RESAMPLE"}])).cache()
    assert made.count() == 2 and {r["priority"] for r in made.collect()} == {"RESAMPLE", "REVIEW"}
    listed = cases.list_cases(made).collect()
    assert [r["priority"] for r in listed] == ["RESAMPLE", "REVIEW"] and listed[0]["screening_date"] == "01-04-2026"
    ddl = "case_id string, status string, disposition string, confirmation_reference string"
    change = spark.createDataFrame([(listed[1]["case_id"], "lab_pending", "Controlled resample sent", None)], ddl)
    after = cases.checked_dispositions(made, change).cache()
    assert [(r["status"], r["disposition"]) for r in cases.list_cases(after, "LAB_PENDING").collect()] == [("LAB_PENDING", "Controlled resample sent")]
    more = spark.createDataFrame([(listed[1]["case_id"], "CONFIRMED", None, "COC-1")], ddl)
    final = cases.list_cases(cases.checked_dispositions(after, more), "CONFIRMED").first()
    assert (final["disposition"], final["confirmation_reference"]) == ("Controlled resample sent", "COC-1")
    again = cases.merge_cases(after, made)
    assert again.count() == 2 and again.where("status = 'LAB_PENDING'").count() == 1
    with pytest.raises(ValueError, match="unsupported status"):
        cases.checked_dispositions(made, spark.createDataFrame([(listed[0]["case_id"], "FRAUD", None, None)], ddl))
    with pytest.raises(ValueError, match="unknown case_id"):
        cases.checked_dispositions(made, spark.createDataFrame([("missing", "OPEN", None, None)], ddl))


def test_keyed_merge_treats_nulls_as_equal(spark):
    old = spark.createDataFrame([(None, 1, "old"), ("a", 1, "old"), ("b", 1, "old")], "k string, j int, v string")
    new = spark.createDataFrame([(None, 1, "new"), ("a", 1, "new"), ("a", 1, "new"), ("c", 1, "new")], "k string, j int, v string")
    got = {(r["k"], r["v"]) for r in merge.keyed_merge(old, new, ["k", "j"]).collect()}
    assert got == {(None, "new"), ("a", "new"), ("b", "old"), ("c", "new")}
    kept = {(r["k"], r["v"]) for r in merge.keyed_merge(old, new, ["k", "j"], preserve_existing=True).collect()}
    assert kept == {(None, "old"), ("a", "old"), ("b", "old"), ("c", "new")}
    assert merge.keyed_merge(old.where("false"), new, ["k", "j"]).count() == 3


def test_batches_hold_one_month(records):
    with pytest.raises(ValueError, match="same month"):
        merge.single_period(records([{"file_month": 4}, {"file_month": 5}]))
    assert merge.single_period(records([{}, {}])) == (2025, 6)


def test_listing_numbered_over_many_ranges(spark, flags):
    """Places follow the listing over several partitions, and no plan brings the rows to one task."""
    given = [{"serial_no": n, "file_month": 1 + n % 5, "confidence": ["RESAMPLE", "REVIEW", "MONITOR"][n % 3]} for n in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = cases.review_cases(flags(given)).cache()
        listed = cases.numbered(cases.list_cases(made))
        got = listed.collect()
        assert listed.rdd.getNumPartitions() > 1 and "Window" not in listed._jdf.queryExecution().toString()
        rank = {"RESAMPLE": 1, "REVIEW": 2, "MONITOR": 3}
        wanted = sorted(made.collect(), key=lambda r: (-r["file_year"], -r["file_month"], rank[r["priority"]], r["case_id"]))
        assert {r["case_id"]: r["place"] for r in got} == {r["case_id"]: n for n, r in enumerate(wanted, 1)}
        page = cases.case_page(made, 41, 60).collect()
        assert {r["case_id"] for r in page} == {r["case_id"] for r in wanted[40:60]}
        assert cases.numbered(cases.list_cases(made, "DISMISSED")).collect() == []
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
