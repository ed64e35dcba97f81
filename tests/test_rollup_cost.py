"""Roll-ups, lists and cases read, deal and write no more than they need."""

from __future__ import annotations

import glob

from curdline.operators import bundle, cases, rollups
from curdline.schema import BATCH, FLAG_COLUMNS, NEXT_STEP, PERIOD
from curdline.sources import tables


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def _flags(spark, rows):
    texts = {"facility", "society_name", "shift", "vehicle", "diagnosis", "confidence", "explanation", "confidence_note", "season"}
    kinds = {"date": "date", "file_year": "int", "file_month": "int", "seasonal_likely": "int", "serial_no": "int"}
    plain = {"facility": "Hillside", "dcs": 7.0, "society_name": "Mill Lane", "file_year": 2025, "file_month": 6, "seasonal_likely": 0,
             "diagnosis": "UNCLASSIFIED_SCREENING_SIGNAL", "confidence": "REVIEW", "z_snf": 3.0}
    schema = ", ".join(f"{c} {kinds.get(c) or ('string' if c in texts else 'double')}" for c in FLAG_COLUMNS)
    return spark.createDataFrame([[(plain | row).get(c) for c in FLAG_COLUMNS] for row in rows], schema)


def test_period_totals_deal_societies_once_and_count_null_ones(records):
    given = records([{"dcs": d, "serial_no": i} for i, d in enumerate([1.0, 1.0, 2.0, None, None])] + [{"facility": None}])
    totals = rollups.record_totals(given)
    assert "Expand" not in _plan(totals) and _plan(totals).count("Aggregate") == 2
    found = {r["facility"]: (r["records_processed"], r["distinct_dcs"], r["distinct_societies"]) for r in totals.collect()}
    assert found == {"Hillside": (5, 2, 3), None: (1, 1, 1)}
    both = records([{"facility": f, "dcs": 7.0} for f in "AB"])
    assert rollups.record_totals(both, BATCH).first().asDict() == {
        "file_year": 2025, "file_month": 6, "records_processed": 2, "distinct_dcs": 1, "distinct_societies": 2,
    }


def test_month_summaries_read_the_records_once(spark, records, tmp_path):
    records([{"serial_no": i} for i in range(3)] + [{"facility": None}]).write.parquet(str(tmp_path / "records"))
    given = spark.read.parquet(str(tmp_path / "records"))
    summaries = rollups.month_summaries(given, rollups.flag_counts(_flags(spark, [{"serial_no": 1}])))
    assert _plan(summaries).count("parquet") == 1
    assert [(r["facility"], r["records_processed"], r["mode"]) for r in summaries.collect()] == [("Hillside", 3, "detection")]


def test_a_flags_text_is_made_once_for_all_its_lists(spark, records):
    weak = {"confidence": "MONITOR", "z_snf": 0.5, "z_fat": 0.5, "z_clr": 0.5}
    flags = _flags(spark, [{"serial_no": 1}, {"serial_no": 2, "seasonal_likely": 1}, {"serial_no": 3, **weak}, {"serial_no": 4, "seasonal_likely": None}])
    none = spark.createDataFrame([], "facility string, file_year int, file_month int")
    baselines = spark.createDataFrame([], "facility string, dcs double, society_name string, season string, record_count bigint, prior_month_count "
                                          "bigint, same_season_prior_month_count bigint, eligible int, file_year int, file_month int")
    items = bundle.list_items(none, baselines, flags, rollups.flag_counts(flags), none, PERIOD)
    held = items.selectExpr("list", "get_json_object(item_json, '$.serial_no') AS serial").where("serial IS NOT NULL").collect()
    assert sorted((r["list"], r["serial"]) for r in held) == [
        *[("anomaly_records", s) for s in "1234"], ("detail_rows", "1"), ("report_records", "1"), ("report_records", "3"),
    ]
    assert _plan(items).count("Generate explode") == 1


def test_tables_of_texts_are_stored_small(spark):
    stored = tables.materialized(spark.range(9).selectExpr("repeat(CAST(id AS STRING), 99) AS item_json"), "items", "zstd")
    folder = stored.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert stored.count() == 9 and all(".zstd." in f for f in glob.glob(f"{folder}/*.parquet"))


def test_case_duplicates_are_sorted_without_what_all_cases_share(spark):
    made = cases.review_cases(_flags(spark, [{"serial_no": 1}, {"serial_no": 1, "confidence": "RESAMPLE"}, {"serial_no": 2}]))
    plan = _plan(made)
    assert plan.index(NEXT_STEP[:30]) < plan.index("Window") and NEXT_STEP[:30] not in plan[plan.index("Window"):]
    assert sorted((r["priority"], r["status"], r["recommended_next_step"]) for r in made.collect()) == [
        ("RESAMPLE", "OPEN", NEXT_STEP), ("REVIEW", "OPEN", NEXT_STEP),
    ]
