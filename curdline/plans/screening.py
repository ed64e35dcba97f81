"""The screening job as one dataflow.

Baselines depend on month statistics and those depend only on records, never on flags. So all periods are
scored in one pass; there is no loop over months.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curdline.functions.expressions import month_index
from curdline.operators import bundle, cases, merge, rollups, rules, shared_events
from curdline.operators.baselines import baselines_by_period
from curdline.operators.month_stats import month_stats
from curdline.schema import (
    BASELINE_KEYS,
    BATCH,
    BATCH_FACILITY,
    BUNDLE,
    BUNDLE_ITEM,
    EVENT_KEYS,
    FLAG_KEYS,
    MONTH_KEYS,
    MONTH_STATS,
    PERIOD,
    REVIEW_CASE,
)
from curdline.sources import tables


def score(records: DataFrame, baselines: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """All flags with category, explanation, adjusted priority and shared-event mark.

    The records that a rule marks are stored first: the shared events need all of them before the first can be
    written, and a plan that read them twice would score every record twice.
    """
    fired = tables.materialized(rules.apply_rules(records, baselines), "fired", "zstd")
    marked = shared_events.mark_shared_events(fired, records, active)
    explained = rules.explain(rules.diagnose(marked))
    return shared_events.ordered_flags(rules.adjust_priority(explained))


def screen(records: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Flags of all periods of ``records``, from raw records; they are scored once and stored, the rest is one plan."""
    stats = month_stats(records)
    known = stats if history is None else merge.keyed_merge(history, stats, MONTH_KEYS)
    return score(records, baselines_by_period(known, records.select("file_year", "file_month").distinct()))


@dataclass(frozen=True)
class StateTables:
    """Locations of the derived tables below one folder."""

    root: str

    def __getattr__(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def run_incremental(
    spark: SparkSession, records: DataFrame, state_dir: str, filename: str = "", stored: bool = False,
    force: bool = False,
) -> DataFrame:
    """Screen the periods that have no bundle yet and merge the results into the derived tables.

    With ``force`` all periods of ``records`` are screened, and what the tables held of them is replaced, so that a
    corrected report of one facility can be run again.

    Several stages read the records. Unless they come from a ``stored`` columnar table, the new ones are
    written once, so that report files are not parsed again for each stage.
    """
    state = StateTables(state_dir)
    bundles = tables.read_table(spark, state.report_bundles, BUNDLE)
    fresh = records if force else merge.only_new_periods(records, bundles)
    if fresh.limit(1).isEmpty():
        raise ValueError("No new reporting periods were available; existing periods were left unchanged.")
    return _run(spark, fresh, state, PERIOD, filename, stored)


def run_batch(
    spark: SparkSession, records: DataFrame, state_dir: str, force: bool = False, filename: str = "",
    stored: bool = False,
) -> DataFrame:
    """Screen one month of several facilities as a single run with identity ALL."""
    state = StateTables(state_dir)
    year, month = merge.single_period(records)
    bundles = tables.read_table(spark, state.report_bundles, BUNDLE)
    if not force and merge.duplicate_period(bundles, BATCH_FACILITY, year, month):
        raise RuntimeError(f"Consolidated {year}-{month:02d} report is already present; use force to replace it.")
    return _run(spark, records, state, BATCH, filename, stored)


def _run(
    spark: SparkSession, records: DataFrame, state: StateTables, scope: list[str], filename: str, stored: bool
) -> DataFrame:
    """Write every derived table, bundles last.

    A bundle marks its period as done. If the job dies earlier, the period is simply computed again. The audit of every
    run is also appended to a log, once, and a ledger keeps the order of the runs. Whatever the
    tables held of the run's periods is replaced, also rows that are not found again; only review cases are merged,
    as they carry human work. A batch replaces its month but for facilities that have documents of their own.
    """
    if not stored:
        records = tables.materialized(records, "records")
    months = tables.materialized(records.select(*BATCH).distinct(), "months")

    def of_these_months(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(months), BATCH, "left_semi")

    run_periods = tables.materialized(records.select(*PERIOD).distinct(), "run_periods")
    done = merge.completed_periods(tables.read_table(spark, state.report_bundles, BUNDLE))
    own = tables.materialized(done.where(F.col("facility") != BATCH_FACILITY), "own_documents")

    def others(stored_rows: DataFrame) -> DataFrame:
        rest = stored_rows.join(run_periods, PERIOD, "left_anti")
        return rest if "facility" in scope else rest.join(own, PERIOD, "left_semi")

    def save(name: str, rows: DataFrame, keys: list[str], preserve_existing: bool = False) -> None:
        keep = None if preserve_existing else others
        tables.upsert(spark, getattr(state, name), rows, keys, preserve_existing, months, keep)

    save("month_stats", month_stats(records, F.lit(filename)), MONTH_KEYS)
    known = tables.read_table(spark, state.month_stats, MONTH_STATS)
    # The stored table also holds earlier rows of these months; a run reports on its own facilities.
    stats = of_these_months(known).join(run_periods, PERIOD, "left_semi")

    target_baselines = baselines_by_period(known, months)
    save("baselines", target_baselines, BASELINE_KEYS)
    baselines = of_these_months(tables.read_table(spark, state.baselines, target_baselines.schema))

    # a row for each shift, from all records: flags and daily summary need it
    active = tables.materialized(shared_events.active_societies(records), "active_societies")
    flags = tables.materialized(score(records, baselines, active), "flags", "zstd")
    counts = tables.materialized(rollups.flag_counts(flags), "flag_counts")
    report = shared_events.reportable(flags)
    daily = shared_events.daily_summary(flags, active)
    totals = rollups.period_totals(records, counts, scope)
    audit = tables.materialized(rollups.audit_trail(totals, scope, BATCH_FACILITY), "audit")

    save("flagged", flags, FLAG_KEYS)
    save("daily_summary", daily, EVENT_KEYS)
    save("severity", rollups.severity(counts, None), MONTH_KEYS)
    save("month_summaries", rollups.month_summaries(records, counts, scope), PERIOD)
    save("audit_trail", audit, [*PERIOD, "metric"])
    save("review_cases", cases.review_cases(report), ["case_id"], preserve_existing=True)

    # a run that is repeated after a failure finds the same newest documents, so it has the same name
    done_version = tables.VersionedTable(spark, state.report_bundles, BUNDLE).state()[0]
    periods = run_periods.agg(F.bit_xor(F.xxhash64(*PERIOD))).first()[0]
    run = f"{done_version}:{periods}"
    ledger = run_periods.withColumn("sequence", F.lit(done_version + 1).cast("bigint"))
    tables.append_once(spark, state.run_ledger, ledger, run)
    tables.append_once(spark, state.audit_log, audit.withColumn("run", F.lit(run)), run)

    history = _history_counts(known, scope, tables.read_table(spark, state.run_ledger, ledger.schema))
    own_baselines = baselines.join(run_periods, PERIOD, "left_semi")
    items = bundle.list_items(stats, own_baselines, flags, counts, daily, scope)
    save("bundle_items", items, [*PERIOD, "list", "item_json"])
    runs = records.select(*PERIOD).distinct() if "facility" in scope else months.withColumn("facility", F.lit(BATCH_FACILITY))
    own_items = tables.read_table(spark, state.bundle_items, BUNDLE_ITEM).join(F.broadcast(runs), PERIOD, "left_semi")
    documents = bundle.documents(records, stats, own_baselines, counts, history, own_items, scope, filename)
    save("report_bundles", documents, PERIOD)
    return rollups.run_summary(audit)


def _history_counts(known: DataFrame, scope: list[str], ledger: DataFrame) -> DataFrame:
    """Month-statistics rows available to each run.

    The ledger tells in which run a period was computed. Within an incremental run the facilities of a month are
    numbered in name order; a batch sees all earlier months.
    """
    if "facility" in scope:
        return rollups.history_counts(known, ledger)
    per_month = known.groupBy(*BATCH).agg(F.count(F.lit(1)).alias("rows"))
    later = per_month.select(F.struct(*BATCH, "rows").alias("m")).agg(F.collect_list("m").alias("months"))
    return later.select(F.explode("months").alias("m"), "months").select(
        "m.file_year", "m.file_month",
        F.aggregate(
            F.filter("months", lambda x: month_index(x["file_year"], x["file_month"])
                     < month_index(F.col("m.file_year"), F.col("m.file_month"))),
            F.lit(0).cast("bigint"), lambda acc, x: acc + x["rows"],
        ).alias("historical_month_stats_count"),
    )


def skipped_periods(spark: SparkSession, records: DataFrame, state_dir: str) -> DataFrame:
    """Periods of the input that a run would leave out because they are done."""
    bundles = tables.read_table(spark, StateTables(state_dir).report_bundles, BUNDLE)
    return merge.skipped_periods(records, bundles)


def read_cases(spark: SparkSession, state_dir: str) -> DataFrame:
    return tables.read_table(spark, StateTables(state_dir).review_cases, REVIEW_CASE)


def update_cases(spark: SparkSession, state_dir: str, updates: DataFrame) -> None:
    """Apply human dispositions to stored cases; only the months of the updated cases are rewritten."""
    stored = read_cases(spark, state_dir)
    changed = cases.checked_dispositions(stored.join(updates, "case_id", "left_semi"), updates)
    tables.upsert(spark, StateTables(state_dir).review_cases, changed, ["case_id"])
