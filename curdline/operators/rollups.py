"""Roll-ups over flags, records and month statistics.

Almost all of them read ``flag_counts``: flags counted per society, category, priority and suppression. That
one aggregate combines on the map side, so what follows works on a small table, however many flags one
society or period has. Top-k lists filter directly on ``row_number``, which Spark turns into a partial
top-k in front of the shuffle. ``scope`` is the unit of one report: a facility's month, or a whole month
for a batch of facilities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curdline.functions.expressions import (
    fixed,
    most_frequent_by,
    month_index,
    priority_rank,
    zscore,
)
from curdline.operators.rules import rules_fired
from curdline.schema import (
    AUDIT_METRICS,
    CATEGORY_KEYWORDS,
    LIMITS,
    PERIOD,
    PRIORITIES,
    RECURRING_INDICATOR,
    RECURRING_TEXT,
    SEED_NOTE,
)

_SOCIETY_NAME = ["facility", "dcs", "society_name"]


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy(
        *PERIOD, "dcs", "society_name", "diagnosis", "confidence", "seasonal_likely"
    ).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def final_counts(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("seasonal_likely") == 0)


def top_rows(df: DataFrame, scope: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*scope).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)


def _with_main_category(counts: DataFrame, keys: list[str], total: str) -> DataFrame:
    """Counts per key with the most frequent category (smallest name on ties)."""
    per_category = counts.groupBy(*keys, "diagnosis").agg(F.sum("n").alias("n"))
    return per_category.groupBy(*keys).agg(
        F.sum("n").alias(total), most_frequent_by(F.col("n"), F.col("diagnosis")).alias("primary_diagnosis")
    )


# --- severity ---------------------------------------------------------------------

def severity(counts: DataFrame, last_periods: int | None = LIMITS.severity_periods) -> DataFrame:
    """Flag frequency of each society and month, over the latest periods (all periods with ``None``)."""
    report = final_counts(counts)
    if last_periods is not None:
        ym = month_index(F.col("file_year"), F.col("file_month"))
        latest = report.select(ym.alias("ym")).distinct().orderBy(F.desc("ym")).limit(last_periods)
        report = report.where(ym >= latest.agg(F.min("ym")).scalar())
    flags = F.col("flags")
    level = (
        F.when(flags >= 30, "VERY_FREQUENT").when(flags >= 15, "FREQUENT").when(flags >= 8, "RECURRING")
        .otherwise("ISOLATED")
    )
    keys = [*_SOCIETY_NAME, "file_year", "file_month"]
    return _with_main_category(report, keys, "flags").select(
        *keys, "flags", level.alias("severity"), "primary_diagnosis"
    )


# --- month summary and audit --------------------------------------------------------

def record_totals(records: DataFrame, scope: list[str] = PERIOD) -> DataFrame:
    """Records and two readings of "active societies": distinct dcs, and distinct (facility, dcs)."""
    per_society = records.groupBy(*PERIOD, "dcs").agg(F.count(F.lit(1)).alias("n"))
    # within a facility's month each society is one row, so counting distinct ones would only deal them once more
    distinct = F.count("dcs") if set(PERIOD) <= set(scope) else F.countDistinct("dcs")
    return per_society.groupBy(*scope).agg(
        F.sum("n").alias("records_processed"),
        distinct.alias("distinct_dcs"),
        F.count(F.lit(1)).alias("distinct_societies"),
    )


def flag_totals(counts: DataFrame, scope: list[str] = PERIOD) -> DataFrame:
    final = F.col("seasonal_likely") == 0
    zero = F.lit(0).cast("bigint")
    return counts.groupBy(*scope).agg(
        F.sum("n").alias("initial_flags"),
        F.coalesce(F.sum(F.when(~final, F.col("n"))), zero).alias("seasonal_suppressed"),
        F.coalesce(F.sum(F.when(final, F.col("n"))), zero).alias("final_flags"),
        F.coalesce(F.sum(F.when(final & (F.col("confidence") == PRIORITIES[0]), F.col("n"))), zero)
        .alias("priority_resample_flags"),
    )


def period_totals(records: DataFrame, counts: DataFrame, scope: list[str] = PERIOD) -> DataFrame:
    """One row per scope with all totals, zero where nothing was flagged, and the run mode."""
    names = ["initial_flags", "seasonal_suppressed", "final_flags", "priority_resample_flags"]
    joined = record_totals(records, scope).join(flag_totals(counts, scope), scope, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in names}).withColumn(
        "mode", F.when(F.col("final_flags") > 0, "detection").otherwise("seed_only")
    )


def top_flagged_societies(counts: DataFrame, scope: list[str] = PERIOD, limit: int = 5) -> DataFrame:
    keys = list(dict.fromkeys([*scope, "dcs", "society_name"]))
    per_society = _with_main_category(final_counts(counts), keys, "flags")
    return top_rows(per_society, scope, [F.desc("flags"), F.col("dcs"), F.col("society_name")], limit)


def month_summaries(records: DataFrame, counts: DataFrame, scope: list[str] = PERIOD) -> DataFrame:
    """One row per facility and month, also where nothing was flagged.

    The mode belongs to the run: with a batch scope it is shared by all facilities of the month.
    """
    top = top_flagged_societies(counts).groupBy(*PERIOD).agg(
        F.sort_array(F.collect_list(F.struct("rank", "dcs", "society_name", "flags", "primary_diagnosis"))).alias("top")
    )
    main = _with_main_category(final_counts(counts), PERIOD, "category_total")
    totals = period_totals(records, counts).dropna(subset=scope)
    if scope != PERIOD:  # else the run is the period: its totals hold its mode, and the records are read once
        totals = totals.drop("mode").join(period_totals(records, counts, scope).select(*scope, "mode"), scope)
    joined = totals.join(main, PERIOD, "left").join(top, PERIOD, "left")
    category = F.coalesce("primary_diagnosis", F.lit(""))
    listed = F.transform(
        F.coalesce("top", F.array().cast(top.schema["top"].dataType)),
        lambda s: F.struct(s["dcs"].alias("dcs"), s["society_name"].alias("society_name"),
                           s["flags"].alias("flags"), s["primary_diagnosis"].alias("primary_diagnosis")),
    )
    return joined.select(
        "facility", "file_month", "file_year", "records_processed", F.col("distinct_dcs").alias("societies_active"),
        "initial_flags", "seasonal_suppressed", "final_flags",
        F.col("priority_resample_flags").alias("high_confidence_flags"), "priority_resample_flags",
        category.alias("top_diagnosis"), category.alias("top_screening_category"),
        listed.alias("top_flagged_societies"),
        F.when(F.col("mode") == "detection", "").otherwise(SEED_NOTE).alias("notes"), "mode",
    )


def audit_trail(totals: DataFrame, scope: list[str] = PERIOD, batch_label: str | None = None) -> DataFrame:
    """Tall audit table: one row per metric and run."""
    values = totals.withColumn("societies_active", F.col("distinct_societies"))
    tall = values.unpivot([*scope, "mode"], AUDIT_METRICS, "metric", "value")
    if "facility" not in scope:
        tall = tall.withColumn("facility", F.lit(batch_label))
    return tall.select("facility", "file_month", "file_year", "metric", "value", "mode")


def run_summary(audit: DataFrame) -> DataFrame:
    """Audit metrics pivoted back to one row per run."""
    wanted = {"records_processed": "records_processed", "initial_flags": "initial_flags",
              "seasonal_suppressed": "seasonal_suppressed", "final_flags": "final_flags"}
    return audit.groupBy("facility", "file_year", "file_month", "mode").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(a) for m, a in wanted.items()]
    )


def processing_metrics(records: DataFrame, totals: DataFrame, scope: list[str] = PERIOD) -> DataFrame:
    facilities = records.groupBy(*scope).agg(F.countDistinct("facility").alias("facility_count"))
    return totals.join(facilities, scope).select(
        *scope, "records_processed", F.col("distinct_dcs").alias("societies_active"), "facility_count", "mode"
    )


def history_counts(stats: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Rows of month statistics each run could read: those of all runs before it.

    ``ledger`` says in which run a period was computed (facility, file_year, file_month, sequence); a month that came
    late was computed after later months. Within a run, and without a ledger, periods come in (year, month, facility)
    order. A running total over the months of each run (a calendar's worth of rows) plus one over the facilities of
    a month.
    """
    per_run = stats.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("rows"))
    if ledger is None:
        per_run = per_run.withColumn("sequence", F.lit(0).cast("bigint"))
    else:
        told = ledger.groupBy(*PERIOD).agg(F.max("sequence").alias("sequence"))
        per_run = per_run.join(told, PERIOD, "left").withColumn("sequence", F.coalesce("sequence", F.lit(0).cast("bigint")))
    when = ["sequence", "file_year", "file_month"]
    per_month = per_run.groupBy(*when).agg(F.sum("rows").alias("rows"))

    def place(m: Column) -> Column:
        return F.struct(m["sequence"], month_index(m["file_year"], m["file_month"]))

    months = per_month.agg(F.collect_list(F.struct(*when, "rows")).alias("months")).select(
        F.explode("months").alias("m"), "months"
    ).select(
        *[f"m.{c}" for c in when],
        F.aggregate(
            F.filter("months", lambda x: place(x) < place(F.col("m"))), F.lit(0).cast("bigint"), lambda acc, x: acc + x["rows"],
        ).alias("before_month"),
    )
    in_month = Window.partitionBy(*when).orderBy("facility")
    earlier = F.sum("rows").over(in_month.rowsBetween(Window.unboundedPreceding, -1))
    return per_run.withColumn("before_run", F.coalesce(earlier, F.lit(0).cast("bigint"))).join(months, when).select(
        *PERIOD, (F.col("before_month") + F.col("before_run")).alias("historical_month_stats_count"),
    )


# --- facility and category views ------------------------------------------------------

def facility_overview(records: DataFrame, scope: list[str] = PERIOD) -> DataFrame:
    def two_digits(m: str) -> Column:
        return F.rint(F.round(F.avg(m), 9) * 100) / 100

    keys = list(dict.fromkeys([*scope, "facility"]))
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("dcs").alias("societies"),
        two_digits("fat_pct").alias("avg_fat"), two_digits("snf_pct").alias("avg_snf"),
        two_digits("clr").alias("avg_clr"),
    )


def category_distribution(counts: DataFrame, scope: list[str] = PERIOD) -> DataFrame:
    return final_counts(counts).groupBy(*scope, "diagnosis").agg(F.sum("n").alias("count"))


def priority_distribution(counts: DataFrame, scope: list[str] = PERIOD) -> DataFrame:
    return final_counts(counts).groupBy(*scope, "confidence").agg(F.sum("n").alias("count"))


def recurring_indicators(counts: DataFrame, minimum_signals: int = 2, scope: list[str] = PERIOD) -> DataFrame:
    """Repeated signals of one society and category within a run; null keys form groups of their own."""
    urgent = F.min(priority_rank(F.col("confidence")))
    priority = F.when(urgent == 1, PRIORITIES[0]).when(urgent == 2, PRIORITIES[1]).otherwise(PRIORITIES[2])
    keys = list(dict.fromkeys([*scope, *_SOCIETY_NAME, "diagnosis"]))
    return (
        final_counts(counts).groupBy(*keys)
        .agg(
            F.sum("n").alias("screening_signal_count"), F.min("first_date").alias("first_signal_date"),
            F.max("last_date").alias("last_signal_date"), priority.alias("highest_priority"),
        )
        .where(F.col("screening_signal_count") >= minimum_signals)
        .withColumns({"indicator": F.lit(RECURRING_INDICATOR), "interpretation": F.lit(RECURRING_TEXT)})
    )


def in_recurrence_order(indicators: DataFrame) -> DataFrame:
    return indicators.orderBy(F.desc("screening_signal_count"), "facility", "dcs", "society_name", "diagnosis")


def calibration_watchlist(stats: DataFrame, scope: list[str] = PERIOD, limit: int = 15) -> DataFrame:
    """Societies whose monthly means lie far from their facility's, per run."""
    names = {"fat": "fat_pct_mean", "snf": "snf_pct_mean", "clr": "clr_mean"}
    facility_run = list(dict.fromkeys(["facility", *scope]))
    facility = stats.groupBy(*facility_run).agg(*[
        c for k, m in names.items()
        for c in (F.round(F.avg(m), 9).alias(f"{k}_avg"),
                  F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 9).alias(f"{k}_dev"))
    ])
    scored = stats.join(facility, facility_run)
    total = sum(
        (F.abs(zscore(F.col(m), F.col(f"{k}_avg"), F.col(f"{k}_dev"))) for k, m in names.items()), F.lit(0.0)
    )
    rows = scored.withColumn("score", total).select(
        *facility_run, "dcs", "society_name", "record_count",
        *[F.col(m).alias(f"{k}_mean") for k, m in names.items()],
        fixed("score", 2).cast("double").alias("deviation_score"),
    )
    order = [F.desc("deviation_score"), F.col("facility"), F.col("dcs"), F.col("society_name")]
    return top_rows(rows, scope, order, limit)


def top_signals(counts: DataFrame, scope: list[str] = PERIOD, limit: int = 15) -> DataFrame:
    keys = list(dict.fromkeys([*scope, *_SOCIETY_NAME, "diagnosis"]))
    rows = final_counts(counts).groupBy(*keys).agg(F.sum("n").alias("count"))
    order = [F.desc("count"), F.col("facility"), F.col("dcs"), F.col("society_name"), F.col("diagnosis")]
    return top_rows(rows, scope, order, limit)


def category_share(counts: DataFrame, scope: list[str] = PERIOD, limit: int = 5) -> DataFrame:
    """Most frequent categories of each facility and their share of its signals."""
    keys = list(dict.fromkeys([*scope, "facility"]))
    rows = final_counts(counts).groupBy(*keys, "diagnosis").agg(F.sum("n").alias("count"))
    totals = final_counts(counts).groupBy(*keys).agg(F.sum("n").alias("total"))
    return top_rows(rows, keys, [F.desc("count"), F.col("diagnosis")], limit).join(totals, keys).select(
        *keys, "rank", "diagnosis", "count", (F.col("count") / F.col("total") * 100).alias("pct_of_facility")
    )


def top_by_keyword(counts: DataFrame, scope: list[str] = PERIOD, limit: int = 5) -> DataFrame:
    """Societies with most signals in each family of categories; a category may belong to several families."""
    families = F.filter(F.array(*map(F.lit, CATEGORY_KEYWORDS)), lambda k: F.contains(F.col("diagnosis"), k))
    keys = list(dict.fromkeys([*scope, "keyword", *_SOCIETY_NAME]))
    rows = final_counts(counts).withColumn("keyword", F.explode(families)).groupBy(*keys).agg(F.sum("n").alias("count"))
    order = [F.desc("count"), F.col("facility"), F.col("dcs"), F.col("society_name")]
    return top_rows(rows, [*scope, "keyword"], order, limit)


# --- detail rows ------------------------------------------------------------------------

def is_detail() -> Column:
    """Whether a flag is final and no weak unclassified one."""
    weak = (F.col("diagnosis") == "UNCLASSIFIED_SCREENING_SIGNAL") & (F.col("confidence") == "MONITOR")
    for z in ["z_snf", "z_fat", "z_clr"]:
        weak = weak & (F.abs(F.col(z)) <= 1.5)
    return (F.col("seasonal_likely") == 0) & ~F.coalesce(weak, F.lit(False))


def detail_rows(flags: DataFrame) -> DataFrame:
    """Final flags without weak unclassified ones."""
    return flags.where(is_detail())


def society_severity(severities: DataFrame) -> DataFrame:
    """One severity per society and period; of several names the last one counts."""
    keys = ["facility", "dcs", "file_year", "file_month"]
    return severities.groupBy(*keys).agg(
        F.max_by("severity", "society_name").alias("severity"),
        F.max_by("primary_diagnosis", "society_name").alias("primary_diagnosis"),
    )


def with_severity(details: DataFrame, severities: DataFrame) -> DataFrame:
    keys = ["facility", "dcs", "file_year", "file_month"]
    joined = details.join(society_severity(severities), keys, "left")
    return joined.withColumn("severity", F.coalesce("severity", F.lit("ISOLATED")))


def focus_details(details: DataFrame, severities: DataFrame, scope: list[str] = PERIOD) -> DataFrame:
    """Detail rows of frequently flagged societies, or all of a run's rows if it has none of those."""
    rows = with_severity(details, severities)
    frequent = F.col("severity").isin("VERY_FREQUENT", "FREQUENT")
    runs = rows.groupBy(*scope).agg(F.max(frequent).alias("has_focus"))
    return rows.join(runs, scope).where(frequent | ~F.col("has_focus")).drop("has_focus")


def detail_heads(focus: DataFrame, scope: list[str] = PERIOD, societies: int = 8, rows: int = 10) -> DataFrame:
    """First rows of the first societies of each run, with the number of rows left out."""
    group = list(dict.fromkeys([*scope, *_SOCIETY_NAME]))
    sizes = focus.groupBy(*group).agg(F.count(F.lit(1)).alias("total_flags"))
    chosen = top_rows(sizes, scope, [F.col(c) for c in _SOCIETY_NAME], societies, "society_rank")
    order = ["date", "shift", "serial_no", "diagnosis", "qty", "fat_pct", "snf_pct", "clr"]
    heads = top_rows(focus, group, [F.col(c) for c in order], rows, "row_rank")
    return heads.join(chosen, group).withColumn(
        "more_rows", F.greatest(F.col("total_flags") - rows, F.lit(0).cast("bigint"))
    )


# --- projections --------------------------------------------------------------------------

def baseline_snapshot(baselines: DataFrame) -> DataFrame:
    return baselines.select(
        "facility", "dcs", "society_name", "season", "record_count", "prior_month_count",
        "same_season_prior_month_count", "eligible", "file_year", "file_month",
    )


def eligible_baseline_rows(baselines: DataFrame) -> DataFrame:
    """Eligible baseline rows per target month (rows, not societies: seasonal and all-year ones count apart)."""
    return baselines.groupBy("file_year", "file_month").agg(F.sum("eligible").alias("eligible_baseline_rows"))


def exported_flags(flags: DataFrame) -> DataFrame:
    return flags.select(
        "facility", "dcs", "society_name", "date", "shift", "vehicle", "qty", "fat_pct", "snf_pct", "clr",
        "z_snf", "z_fat", "z_clr", "z_qty", rules_fired().alias("rules_fired"), "diagnosis", "confidence",
        "explanation", (F.col("seasonal_likely") == 1).alias("seasonal_suppressed"), "file_month", "file_year",
    )


def exported_summaries(summaries: DataFrame) -> DataFrame:
    return summaries.drop("priority_resample_flags", "top_screening_category")
