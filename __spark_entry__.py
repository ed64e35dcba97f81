"""Queries over the driver tables, one or more per operator, and their DuckDB counterparts.

All queries read the record view of ``curdline.fixtures``. Month statistics, baselines and flags are derived
tables of the screening job: the first query that needs one writes it (from whole tables) to the session's
shared folder, later ones read it, as the job itself does between its stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curdline import fixtures, oracle
from curdline.operators import baselines as bl
from curdline.operators import bundle, cases, merge, rollups, rules, shared_events, validation
from curdline.operators.month_stats import month_stats
from curdline.plans import screening
from curdline.schema import (
    BASELINE_SUFFIXES,
    BATCH,
    BUNDLE,
    EVENT_KEYS,
    FLAG_COLUMNS,
    METRICS,
    MONTH_KEYS,
    PERIOD,
    REPORT_COLUMNS,
    RULES,
    SUFFIXES,
)
from curdline.sources import reports, tables

SMOKE_DIR = "/root/testdata/sf0.001"
IDENTITY = ["facility", "serial_no", "dcs", "date", "shift", "file_year", "file_month"]
_STATS = [f"{m}_{s}" for m in METRICS for s in SUFFIXES]
_BASELINE_STATS = [f"{m}_{s}" for m in METRICS for s in BASELINE_SUFFIXES]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, keys excepted, so that two engines can be compared.

    By arithmetic that is the same in both: their ``round`` functions differ where the seventh digit is a 5.
    """
    return df.selectExpr(*[
        f"floor({f.name} * 1000000 + 0.5D) / 1000000 AS {f.name}"
        if f.dataType.typeName() == "double" and f.name not in ("dcs", "deviation_score") else f"`{f.name}`"
        for f in df.schema
    ])


class Derived:
    """The derived tables of one data set."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.records = fixtures.records(spark, sf_dir)
        self._stored: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = tables.materialized(make(), name, "zstd")
        return self._stored[name]

    @property
    def stats(self) -> DataFrame:
        return self._once("month_stats", lambda: month_stats(self.records))

    @property
    def baselines(self) -> DataFrame:
        return self._once("baselines", lambda: bl.baselines_by_period(self.stats))

    @property
    def flags(self) -> DataFrame:
        return self._once("flags", lambda: screening.score(self.records, self.baselines, self.active))

    @property
    def active(self) -> DataFrame:
        return self._once("active_societies", lambda: shared_events.active_societies(self.records))

    @property
    def counts(self) -> DataFrame:
        return self._once("flag_counts", lambda: rollups.flag_counts(self.flags))

    @property
    def report(self) -> DataFrame:
        return shared_events.reportable(self.flags)

    @property
    def totals(self) -> DataFrame:
        return rollups.period_totals(self.records, self.counts)

    @property
    def severities(self) -> DataFrame:
        return rollups.severity(self.counts, last_periods=None)


@lru_cache(maxsize=4)
def derived(spark: SparkSession, sf_dir: str) -> Derived:
    return Derived(spark, sf_dir)


def entry(spark: SparkSession) -> DataFrame:
    """Classified flags of all facilities and periods, from records to explanation."""
    return rounded(screening.screen(fixtures.records(spark, SMOKE_DIR)))


# --- statistics and baselines -----------------------------------------------------

def q_month_stats(spark, sf_dir):
    columns = [*MONTH_KEYS, "season", "society_name", "record_count", "morning_count", "evening_count", "low_qty_count"]
    return rounded(month_stats(fixtures.records(spark, sf_dir)).select(*columns, *_STATS))


def q_snf_spike_count(spark, sf_dir):
    return month_stats(fixtures.records(spark, sf_dir)).select(*MONTH_KEYS, "high_snf_spike_count")


def _baseline_table(spark, sf_dir):
    return bl.baselines_by_period(derived(spark, sf_dir).stats)


def q_baseline_all_periods(spark, sf_dir):
    columns = [*MONTH_KEYS, "season", "society_name", "record_count", "prior_month_count",
               "same_season_prior_month_count", "eligible"]
    return rounded(_baseline_table(spark, sf_dir).select(*columns, *_BASELINE_STATS))


def q_baseline_snf_trim(spark, sf_dir):
    return rounded(_baseline_table(spark, sf_dir).select(*MONTH_KEYS, "season", "snf_pct_mean", "snf_pct_std"))


def q_baseline_months_without_values(spark, sf_dir):
    known = "CASE WHEN (file_month + CAST(dcs AS BIGINT)) % 3 <> 0 THEN clr END"
    records = fixtures.records(spark, sf_dir).withColumn("clr", F.expr(known))
    rows = bl.baselines_by_period(month_stats(records))
    return rounded(rows.select(*MONTH_KEYS, "season", "record_count", "clr_mean", "clr_std", "clr_median", "clr_p90"))


def q_replaced_periods(spark, sf_dir):
    """Month statistics stored, then those of one facility's even years stored again with fewer producers."""
    stats = derived(spark, sf_dir).stats
    path = f"{tables.shared_folder(spark)}/curdline/{uuid.uuid4().hex}/replaced_periods"
    tables.upsert(spark, path, stats, MONTH_KEYS)
    given = stats.where("facility = 'FacilityA' AND file_year % 2 = 0")
    periods = given.select(*PERIOD).distinct()
    tables.upsert(spark, path, given.where("dcs % 3 <> 0"), MONTH_KEYS, months=periods.select(*BATCH),
                  keep=lambda rows: rows.join(periods, PERIOD, "left_anti"))
    return tables.read_table(spark, path, stats.schema).select(*MONTH_KEYS, "season", "society_name", "record_count")


def q_committed_versions(spark, sf_dir):
    """Both commits of a table after a third write was broken off before its switch: each reads whole."""
    stats = derived(spark, sf_dir).stats
    path = f"{tables.shared_folder(spark)}/curdline/{uuid.uuid4().hex}/versions"
    first = tables.upsert(spark, path, stats, MONTH_KEYS)
    second = tables.upsert(spark, path, stats.where("dcs % 5 = 0").withColumn("record_count", -F.col("record_count")), MONTH_KEYS)
    table = tables.VersionedTable(spark, path, stats.schema)
    table.write(stats.where("dcs % 2 = 0"))  # and no switch
    return table.read(first).withColumn("version", F.lit("first")).union(
        table.read(second).withColumn("version", F.lit("second"))
    ).union(table.read().withColumn("version", F.lit("newest"))).groupBy("version", *PERIOD).agg(
        F.count("*").alias("societies"), F.sum("record_count").alias("record_count"), F.count_if(F.col("record_count") < 0).alias("replaced")
    )


def q_audit_appended(spark, sf_dir):
    """The audit of each year appended as a run of its own, one of them twice; it is made once, as in the job."""
    audit = tables.materialized(rollups.audit_trail(derived(spark, sf_dir).totals), "audit")
    path = f"{tables.shared_folder(spark)}/curdline/{uuid.uuid4().hex}/audit_trail"
    odd, even = (audit.where(F.col("file_year") % 2 == k) for k in (1, 0))
    for run, rows in (("odd years", odd), ("even years", even), ("odd years", odd)):
        tables.append_once(spark, path, rows, run)
    return tables.read_table(spark, path, audit.schema)


def q_baseline_snapshot(spark, sf_dir):
    return rollups.baseline_snapshot(derived(spark, sf_dir).baselines)


def q_eligible_baseline_rows(spark, sf_dir):
    return rollups.eligible_baseline_rows(derived(spark, sf_dir).baselines)


def q_raw_baselines(spark, sf_dir):
    return rounded(bl.baselines_from_records(fixtures.records(spark, sf_dir)))


# --- scoring and rules ----------------------------------------------------------------

def q_scored_records(spark, sf_dir):
    d = derived(spark, sf_dir)
    return rounded(rules.score_records(d.records, d.baselines).select(
        *IDENTITY, "baseline_records", "low_seasonal_data", "z_fat", "z_snf", "z_clr", "z_qty",
        "b_fat", "b_snf", "b_clr", "b_qty",
    ))


def q_rule_flags(spark, sf_dir):
    """Rule outcomes before thin baselines are considered."""
    d = derived(spark, sf_dir)
    fired = rules.any_of([F.col(c) == 1 for c in RULES.values()])
    return rules.score_records(d.records, d.baselines).where(fired).select(*IDENTITY, *RULES.values())


def q_thin_suppression(spark, sf_dir):
    d = derived(spark, sf_dir)
    fired = rules.any_of([F.col(c) == 1 for c in RULES.values()])
    return rules.suppress_thin(rules.score_records(d.records, d.baselines)).groupBy(
        *PERIOD, "thin_baseline", "extreme_z"
    ).agg(F.count(F.lit(1)).alias("records"), F.count_if(fired).alias("flagged"))


def q_diagnosis(spark, sf_dir):
    d = derived(spark, sf_dir)
    return rules.diagnose(rules.apply_rules(d.records, d.baselines)).select(*IDENTITY, "diagnosis", "confidence", "case")


def q_priority_adjust(spark, sf_dir):
    d = derived(spark, sf_dir)
    adjusted = rules.adjust_priority(rules.diagnose(rules.apply_rules(d.records, d.baselines)))
    return adjusted.select(*IDENTITY, "diagnosis", "confidence_base", "confidence", "confidence_note")


def q_rules_fired(spark, sf_dir):
    d = derived(spark, sf_dir)
    return rules.apply_rules(d.records, d.baselines).select(*IDENTITY, rules.rules_fired().alias("rules_fired"))


def q_explanation(spark, sf_dir):
    d = derived(spark, sf_dir)
    flags = rules.adjust_priority(rules.explain(rules.diagnose(rules.apply_rules(d.records, d.baselines))))
    return flags.select(*IDENTITY, "explanation")


def q_flags(spark, sf_dir):
    return rounded(screening.screen(fixtures.records(spark, sf_dir)).select(*FLAG_COLUMNS))


def q_exported_flags(spark, sf_dir):
    return rounded(rollups.exported_flags(derived(spark, sf_dir).flags))


# --- shared events -----------------------------------------------------------------------

def q_active_societies(spark, sf_dir):
    return shared_events.active_societies(fixtures.records(spark, sf_dir))


def q_shared_event(spark, sf_dir):
    d = derived(spark, sf_dir)
    directed = rules.apply_rules(d.records, d.baselines).withColumn("direction", shared_events.direction())
    return rounded(shared_events.shared_event_shares(directed, shared_events.active_societies(d.records)))


def q_report_records(spark, sf_dir):
    return derived(spark, sf_dir).report.select(*IDENTITY, "society_name", "diagnosis", "confidence")


def q_run_mode(spark, sf_dir):
    return derived(spark, sf_dir).totals.select(*PERIOD, "mode")


def q_daily_summary(spark, sf_dir):
    d = derived(spark, sf_dir)
    return rounded(shared_events.daily_summary(d.flags, d.active))


# --- roll-ups ------------------------------------------------------------------------------

def q_severity(spark, sf_dir):
    return rollups.severity(derived(spark, sf_dir).counts)


def q_severity_by_period(spark, sf_dir):
    return derived(spark, sf_dir).severities


def q_month_summary(spark, sf_dir):
    d = derived(spark, sf_dir)
    printed = F.transform("top_flagged_societies", lambda s: F.concat_ws(
        ":", s["dcs"].cast("bigint"), s["society_name"], s["flags"], s["primary_diagnosis"]
    ))
    return rollups.month_summaries(d.records, d.counts).withColumn(
        "top_flagged_societies", F.array_join(printed, "|")
    )


def q_top_societies(spark, sf_dir):
    return rollups.top_flagged_societies(derived(spark, sf_dir).counts).withColumn("rank", F.col("rank").cast("bigint"))


def q_audit_metrics(spark, sf_dir):
    return rollups.audit_trail(derived(spark, sf_dir).totals)


def q_run_summary(spark, sf_dir):
    return rollups.run_summary(rollups.audit_trail(derived(spark, sf_dir).totals))


def q_batch_summary(spark, sf_dir):
    """Whole months as one run over all facilities."""
    d = derived(spark, sf_dir)
    totals = rollups.period_totals(d.records, d.counts, BATCH)
    return rollups.processing_metrics(d.records, totals, BATCH)


def q_processing_metrics(spark, sf_dir):
    d = derived(spark, sf_dir)
    return rollups.processing_metrics(d.records, d.totals)


def q_history_count(spark, sf_dir):
    return rollups.history_counts(derived(spark, sf_dir).stats)


def q_history_count_late(spark, sf_dir):
    """March reports came late: they were computed in a second run."""
    stats = derived(spark, sf_dir).stats
    ledger = stats.select(*PERIOD).distinct().withColumn("sequence", F.when(F.col("file_month") == 3, 2).otherwise(1).cast("bigint"))
    return rollups.history_counts(stats, ledger)


def q_facility_overview(spark, sf_dir):
    return rollups.facility_overview(fixtures.records(spark, sf_dir))


def q_category_distribution(spark, sf_dir):
    return rollups.category_distribution(derived(spark, sf_dir).counts)


def q_priority_distribution(spark, sf_dir):
    return rollups.priority_distribution(derived(spark, sf_dir).counts)


def q_recurring(spark, sf_dir):
    return rollups.in_recurrence_order(rollups.recurring_indicators(derived(spark, sf_dir).counts))


def _ranked(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names or ["rank"]})


def q_watchlist(spark, sf_dir):
    return rounded(_ranked(rollups.calibration_watchlist(derived(spark, sf_dir).stats)))


def q_top_signals(spark, sf_dir):
    return _ranked(rollups.top_signals(derived(spark, sf_dir).counts))


def q_category_share(spark, sf_dir):
    return rounded(_ranked(rollups.category_share(derived(spark, sf_dir).counts)))


def q_keyword_top(spark, sf_dir):
    return _ranked(rollups.top_by_keyword(derived(spark, sf_dir).counts))


def q_detail_rows(spark, sf_dir):
    return rollups.detail_rows(derived(spark, sf_dir).flags).select(*IDENTITY, "diagnosis", "confidence")


def _focus(d: Derived) -> DataFrame:
    return rollups.focus_details(rollups.detail_rows(d.flags), d.severities)


def q_detail_focus(spark, sf_dir):
    return _focus(derived(spark, sf_dir)).select(*IDENTITY, "diagnosis", "severity")


def q_detail_head(spark, sf_dir):
    heads = rollups.detail_heads(_focus(derived(spark, sf_dir)))
    return _ranked(heads, "row_rank", "society_rank").select(
        *IDENTITY, "society_name", "diagnosis", "severity", "row_rank", "society_rank", "total_flags", "more_rows"
    )


# --- cases, merges, periods -------------------------------------------------------------------

def q_review_cases(spark, sf_dir):
    return cases.review_cases(derived(spark, sf_dir).report)


def q_case_list(spark, sf_dir):
    """The listing with the place of each case."""
    found = cases.review_cases(derived(spark, sf_dir).report)
    return cases.numbered(cases.list_cases(found).select("case_id"))


def _updates(all_cases: DataFrame) -> DataFrame:
    """Dispositions for a quarter of the cases, chosen by id."""
    return all_cases.where(F.col("case_id") < "4").select(
        "case_id", F.lit("lab_pending").alias("status"), F.concat(F.lit("resample "), "facility").alias("disposition"),
        F.when(F.col("shift") == "M", F.concat(F.lit("ref "), "case_id")).alias("confirmation_reference"),
    )


def q_case_update(spark, sf_dir):
    found = cases.review_cases(derived(spark, sf_dir).report)
    return cases.apply_dispositions(found, _updates(found)).select(
        "case_id", "status", "disposition", "confirmation_reference"
    )


def q_case_merge(spark, sf_dir):
    """Cases created again by a second run keep the status a person gave them."""
    again = cases.review_cases(derived(spark, sf_dir).report)
    closed = again.where(F.col("case_id") < "4").withColumn("status", F.lit("DISMISSED"))
    return cases.merge_cases(closed, again).select("case_id", "priority", "status")


def q_keyed_merge(spark, sf_dir):
    months = fixtures.records(spark, sf_dir).groupBy(*MONTH_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.max("qty").alias("top")
    )
    existing = months.withColumn("n", -F.col("n")).withColumn("origin", F.lit("old"))
    new = months.where(F.col("file_month").between(4, 9)).withColumn("origin", F.lit("new"))
    return rounded(merge.keyed_merge(existing, new, MONTH_KEYS))


def _some_bundles(records: DataFrame) -> DataFrame:
    """Runs already done: February of each facility, July as one ALL run, FacilityB before 1998."""
    periods = records.select(*PERIOD).distinct()
    july = periods.where(F.col("file_month") == 7).select(F.lit("ALL").alias("facility"), "file_year", "file_month")
    early = (F.col("file_month") == 2) | ((F.col("facility") == "FacilityB") & (F.col("file_year") < 1998))
    return periods.where(early).unionByName(july.distinct())


def q_new_periods(spark, sf_dir):
    rows = fixtures.records(spark, sf_dir)
    fresh = merge.only_new_periods(rows, _some_bundles(rows))
    return fresh.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("records"))


def q_skipped_periods(spark, sf_dir):
    rows = fixtures.records(spark, sf_dir)
    return merge.skipped_periods(rows, _some_bundles(rows))


# --- ingestion --------------------------------------------------------------------------------

def q_file_identity(spark, sf_dir):
    named = fixtures.raw_rows(spark, sf_dir).withColumn("identity", reports.file_identity(F.col("source_file")))
    return named.groupBy("source_file", "identity.facility", "identity.file_month", "identity.file_year").agg(
        F.count(F.lit(1)).alias("rows")
    )


def _header_names(spark, sf_dir):
    return fixtures.headers(spark, sf_dir).withColumn("header", F.split("header_text", r"\|"))


def q_layout_detect(spark, sf_dir):
    return _header_names(spark, sf_dir).select(*PERIOD, reports.layout_of(F.col("header")).alias("schema_layout"))


def q_schema_fingerprint(spark, sf_dir):
    return _header_names(spark, sf_dir).select(
        *PERIOD, reports.schema_fingerprint(F.col("header")).alias("schema_fingerprint")
    )


def _validated(spark, sf_dir):
    return validation.validate(fixtures.raw_rows(spark, sf_dir))


def q_row_rejections(spark, sf_dir):
    return validation.rejected(_validated(spark, sf_dir)).select("source_file", "source_row", "rejection_reason")


def q_accepted_records(spark, sf_dir):
    return validation.accepted(_validated(spark, sf_dir))


def q_rejection_counts(spark, sf_dir):
    return validation.rejection_counts(_validated(spark, sf_dir))


def q_validation_report(spark, sf_dir):
    raw = fixtures.raw_rows(spark, sf_dir).withColumns({
        "schema_layout": F.lit("layout_a"), "schema_fingerprint": F.lit("")
    })
    return validation.validation_report(raw, validation.validate(raw)).select(
        "source_file", "facility", "file_year", "file_month", "rows_seen", "data_rows_seen", "accepted_rows",
        "rejected_rows", "rows_outside_period",
    )


def q_rejected_preview(spark, sf_dir):
    return validation.preview(validation.rejected(_validated(spark, sf_dir))).select("source_file", "source_row")


@lru_cache(maxsize=8)
def _report_folder(spark, sf_dir, kind):
    """The raw rows as report files, written once for each data set."""
    folder = f"{tables.shared_folder(spark)}/curdline/{uuid.uuid4().hex}/reports"
    fixtures.written_reports(spark, sf_dir, folder, kind)
    return folder


#: Bytes of report text that one task reads where its files are cut into many splits.
_TASK_BYTES = 32 << 20


def _over_many_splits(spark, folder, make):
    """A plan made while files are cut into splits of 16 KB, so that most files have several.

    Spark packs the splits into tasks of ``_TASK_BYTES``, at least two for each core: a task for each split would be
    as many tasks and stored files as splits.
    """
    size = reports.report_catalogue(spark, folder).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-size // _TASK_BYTES))
    wanted = {"spark.sql.files.maxPartitionBytes": str(1 << 14), "spark.sql.files.maxPartitionNum": str(tasks)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return tables.materialized(make(), "scanned")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


_SCANNED = ["source_file", "source_row", "facility", "file_year", "file_month", "schema_layout", *REPORT_COLUMNS]


def q_scanned_reports(spark, sf_dir):
    folder = _report_folder(spark, sf_dir, "csv")
    return _over_many_splits(spark, folder, lambda: reports.scan_csv_reports(spark, folder).select(*_SCANNED))


def q_row_numbers(spark, sf_dir):
    folder = _report_folder(spark, sf_dir, "csv")
    rows = _over_many_splits(spark, folder, lambda: reports.scan_csv_reports(spark, folder).select("source_file", "source_row"))
    return rows.groupBy("source_file").agg(
        F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row"), F.countDistinct("source_row").alias("rows")
    )


def q_strict_gate(spark, sf_dir):
    """What the gate decides on each file: refused, and how many records are loaded if such files are left out."""
    folder = _report_folder(spark, sf_dir, "csv")
    raw = reports.scan_csv_reports(spark, folder)
    checked = tables.materialized(validation.validate(raw), "checked")
    report = validation.validation_report(raw, checked, reports.report_files(spark, folder))
    loaded = validation.only_clean_files(validation.accepted(checked), report).groupBy("source_file").agg(F.count("*").alias("n"))
    refused = validation.strict_failures(report).select("source_file", F.lit(True).alias("bad"))
    return report.join(refused, "source_file", "left").join(loaded, "source_file", "left").select(
        "source_file", F.coalesce("bad", F.lit(False)).alias("refused"), "accepted_rows", "rejected_rows",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("loaded"),
    )


def q_scanned_new_reports(spark, sf_dir):
    """Only the files of periods without a document are opened."""
    catalogue = reports.report_catalogue(spark, _report_folder(spark, sf_dir, "csv"))
    fresh = merge.only_new_periods(catalogue, _some_bundles(fixtures.records(spark, sf_dir)))
    return reports.scan_csv_reports(spark, "", files=fresh).groupBy("source_file", "schema_layout").agg(F.count("*").alias("rows"))


def q_parquet_reports(spark, sf_dir):
    """A folder of exports of both layouts, each read by its own header."""
    return reports.scan_parquet_reports(spark, _report_folder(spark, sf_dir, "parquet")).select(*_SCANNED)


# --- documents and the whole job ------------------------------------------------------------------

def _documents(spark, sf_dir):
    """Heads and list rows of all runs; the rows are stored first, as in the job."""
    d = derived(spark, sf_dir)

    def heads():
        own = d.baselines.join(d.records.select(*PERIOD).distinct(), PERIOD, "left_semi")
        return bundle.documents(d.records, d.stats.drop("processed_at"), own, d.counts, rollups.history_counts(d.stats), _items(spark, sf_dir))

    return d._once("documents", heads)


def _items(spark, sf_dir):
    d = derived(spark, sf_dir)

    def items():
        daily = shared_events.daily_summary(d.flags, d.active)
        own = d.baselines.join(d.records.select(*PERIOD).distinct(), PERIOD, "left_semi")
        return bundle.list_items(d.stats.drop("processed_at"), own, d.flags, d.counts, daily)

    return d._once("bundle_items", items)


def q_bundle(spark, sf_dir):
    """What the documents say, read back from their text."""
    numbers = {
        "records_processed": "processing_metrics.records_processed", "societies_active": "processing_metrics.societies_active",
        "initial_flags": "sections.audit_trail.initial_flags", "seasonal_suppressed": "sections.audit_trail.seasonal_suppressed",
        "final_flags": "sections.audit_trail.final_flags", "history_rows": "history_inputs.historical_month_stats_count",
        "detail_rows": "sections.detail_logs.rows.rows", "eligible_baseline_rows": "sections.calibration.eligible_societies",
        **{f"{name}_rows": f"{name}.rows" for name in bundle.LISTS[:-1]},
    }
    texts = {"season": "file_identity.season", "summary_text": "retrieval.summary_text", "run_mode": "processing_metrics.mode"}
    said = {n: F.get_json_object("bundle_json", f"$.{p}").cast("bigint") for n, p in numbers.items()}
    said |= {n: F.get_json_object("bundle_json", f"$.{p}") for n, p in texts.items()}
    said["fields"] = F.size(F.json_object_keys("bundle_json")).cast("bigint")
    said["watchlist_rows"] = F.json_array_length(F.get_json_object("bundle_json", "$.sections.calibration.watchlist")).cast("bigint")
    categories = F.from_json(F.get_json_object("bundle_json", "$.retrieval.top_diagnoses"), "map<string, bigint>")
    said["categorized_flags"] = F.aggregate(F.map_values(F.coalesce(categories, F.create_map().cast("map<string, bigint>"))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _documents(spark, sf_dir).select(*PERIOD, "mode", *[c.alias(n) for n, c in said.items()])


def q_bundle_items(spark, sf_dir):
    """The list rows of the documents, read back from their text: how many, and a sum over each list."""
    read = F.get_json_object("item_json", "$.dcs").cast("double")
    return _items(spark, sf_dir).groupBy(*PERIOD, "list").agg(
        F.count("*").alias("items"), F.sum(F.coalesce(read, F.lit(0.0))).cast("bigint").alias("dcs_total")
    )


def q_top_findings(spark, sf_dir):
    return bundle.top_findings(_documents(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


# The corpus operators and the pipeline over them may be absent; whatever else fails to import is an error.
try:
    import corpus_pipeline
    from curdline.llm import queries as corpus
except ModuleNotFoundError as missing:
    if missing.name != "corpus_pipeline" and not (missing.name or "").startswith("curdline.llm"):
        raise
    corpus = corpus_pipeline = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name[2:]: run for name, run in globals().items() if name.startswith("q_")}
    return own | (corpus.queries() | {"pipeline": corpus_pipeline.run} if corpus else {})


def oracle_sql() -> dict[str, str]:
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus and corpus_pipeline.ORACLE_SQL else {}
    return oracle.oracle_sql() | (corpus.oracle_sql() if corpus else {}) | whole
