"""One nested document per run (B1, W8), in one layout whatever its size.

A document's head is one row: identity, metrics, top lists, texts, and of every long list its name and number of rows.
All of it is bounded. The rows of the long lists (statistics, baselines, flags, severity, ...) are a table of their
own, one JSON object each, stored by month like all tables; a list may be of any length and no row of the head grows
with it. :func:`with_lists` puts the two together for a reader who wants whole documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curdline.functions.expressions import printed_date
from curdline.operators import rollups
from curdline.operators.merge import union_all
from curdline.schema import (
    ACTION_PLAN,
    BATCH_FACILITY,
    DISABLED_RULES,
    DISCLAIMER,
    LEGACY_FIELDS,
    LIMITS,
    METHODOLOGY_VERSION,
    PERIOD,
    RECURRING_SECTION_TEXT,
    RULE_TRIGGERS,
)

#: The long lists, in the order of a document.
LISTS = [
    "current_month_stats", "historical_baselines", "anomaly_records", "report_records", "daily_summary", "severity",
    "recurring_signal_indicators", "detail_rows",
]


def list_items(
    stats: DataFrame, baselines: DataFrame, flags: DataFrame, counts: DataFrame, daily: DataFrame, scope: list[str] = PERIOD
) -> DataFrame:
    """Rows (facility, file_year, file_month, list, item_json): the long lists of all runs.

    A flag is in one to three lists. Its text is made once, and its rows lie next to each other, so that a file holds it once.
    """
    rows = {
        "current_month_stats": stats,
        "historical_baselines": rollups.baseline_snapshot(baselines),
        "daily_summary": _dated(daily),
        "severity": rollups.severity(counts, last_periods=None),
        "recurring_signal_indicators": _dated(rollups.recurring_indicators(counts, scope=scope)),
    }
    facility = F.col("facility") if "facility" in scope else F.lit(BATCH_FACILITY)

    def texts(df: DataFrame, lists: Column) -> DataFrame:
        return df.select(
            facility.alias("facility"), F.col("file_year").cast("int").alias("file_year"), F.col("file_month").cast("int").alias("file_month"),
            lists.alias("list"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("item_json"),
        )

    of_a_flag = F.array_compact(F.array(
        F.lit("anomaly_records"), F.when(F.col("seasonal_likely") == 0, "report_records"), F.when(rollups.is_detail(), "detail_rows"),
    ))
    flagged = texts(_dated(flags), of_a_flag).withColumn("list", F.explode("list"))
    return union_all([*[texts(df, F.lit(name)) for name, df in rows.items()], flagged])


def documents(
    records: DataFrame, stats: DataFrame, baselines: DataFrame, counts: DataFrame, history: DataFrame, items: DataFrame,
    scope: list[str] = PERIOD, filename: str = "",
) -> DataFrame:
    """Rows (facility, file_year, file_month, mode, bundle_json): the heads of all runs, with the sizes of their lists."""
    totals = rollups.period_totals(records, counts, scope)
    severities = rollups.severity(counts, last_periods=None)
    sizes = items.groupBy(*scope, "list").agg(F.count(F.lit(1)).alias("rows")).groupBy(*scope).agg(
        F.map_from_entries(F.collect_list(F.struct("list", "rows"))).alias("list_rows")
    )
    pieces = [totals.select(*scope, "mode"), sizes, *_header(records, stats, counts, totals, severities, history, baselines, scope)]
    # Every piece has at most one row per run, so a union and one aggregate put a document together.
    fields = [c for c in dict.fromkeys(c for p in pieces for c in p.columns) if c not in scope]
    united = union_all([_keyed_by_run(p, scope) for p in pieces])
    whole = united.groupBy("run").agg(*[F.first(c, True).alias(c) for c in fields]).select("*", "run.*")
    facility = F.col("facility") if "facility" in scope else F.lit(BATCH_FACILITY)
    return whole.where(F.col("mode").isNotNull()).select(
        facility.alias("facility"), F.col("file_year").cast("int").alias("file_year"),
        F.col("file_month").cast("int").alias("file_month"), "mode",
        F.to_json(_document(facility, filename), {"ignoreNullFields": "false"}).alias("bundle_json"),
    )


def with_lists(heads: DataFrame, items: DataFrame) -> DataFrame:
    """Heads with ``lists``, a map from each list's name to its rows, for runs that fit in one row."""
    lists = items.groupBy(*PERIOD, "list").agg(F.sort_array(F.collect_list("item_json")).alias("rows"))
    held = lists.groupBy(*PERIOD).agg(F.map_from_entries(F.collect_list(F.struct("list", "rows"))).alias("lists"))
    return heads.join(held, PERIOD, "left").withColumn("lists", F.coalesce("lists", F.create_map().cast("map<string, array<string>>")))


def top_findings(heads: DataFrame) -> DataFrame:
    """The findings a document names first (W8), read back from its text: severities, or where there are none the watchlist."""
    found = F.from_json(
        F.get_json_object("bundle_json", "$.sections.executive_summary.top_findings"),
        "array<struct<facility: string, dcs: double, society_name: string, severity: string, deviation_score: double>>",
    )
    return heads.select(*PERIOD, F.posexplode(found).alias("place", "row")).select(
        *PERIOD, (F.col("place") + 1).alias("rank"), F.col("row.facility").alias("finding_facility"), "row.dcs", "row.society_name",
        F.coalesce("row.severity", F.lit("WATCHLIST")).alias("finding"),
    )


def _keyed_by_run(df: DataFrame, scope: list[str]) -> DataFrame:
    """The scope as one struct column.

    Spark 4.1 zips the children of a union when all are hash-partitioned by the same columns, which fails if
    adaptive execution has changed one child's partition count. A computed key avoids that.
    """
    return df.select(F.struct(*scope).alias("run"), *[c for c in df.columns if c not in scope])


def _dated(df: DataFrame) -> DataFrame:
    dates = [f.name for f in df.schema if f.dataType.typeName() == "date"]
    return df.withColumns({c: printed_date(F.col(c)) for c in dates}) if dates else df


def _top_list(ranked: DataFrame, scope: list[str], name: str) -> DataFrame:
    """A ranked top-k table as one short array per run."""
    cols = [c for c in ranked.columns if c != "rank"]
    collected = ranked.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*cols).alias("row")))).alias(name))
    return collected.withColumn(name, F.col(f"{name}.row"))


def _count_map(rows: DataFrame, scope: list[str], key: str, name: str) -> DataFrame:
    return rows.groupBy(*scope).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "count")))).alias(name)
    )


def _header(records, stats, counts, totals, severities, history, baselines, scope) -> list[DataFrame]:
    facilities = rollups.facility_overview(records, scope)
    facility_list = facilities.groupBy(*scope).agg(
        F.sort_array(F.collect_list("facility")).alias("facilities") if "facility" not in scope
        else F.array(F.first("facility")).alias("facilities"),
        F.sort_array(F.collect_list(
            F.struct("facility", "records", "societies", "avg_fat", "avg_snf", "avg_clr")
        )).alias("facility_metrics"),
    )
    seasons = stats.groupBy(*scope).agg(F.min("season").alias("run_season"))
    watchlist = rollups.calibration_watchlist(stats, scope)
    first_severities = rollups.top_rows(severities, scope, [F.col(c) for c in ["facility", "dcs", "society_name"]], 8)
    eligible = rollups.eligible_baseline_rows(baselines)
    month_wide = totals.select(*scope).join(eligible, ["file_year", "file_month"])
    return [
        totals.drop("distinct_societies", "mode"),
        facility_list,
        seasons,
        _count_map(rollups.category_distribution(counts, scope), scope, "diagnosis", "diagnosis_counts"),
        _count_map(rollups.priority_distribution(counts, scope), scope, "confidence", "confidence_counts"),
        _top_list(rollups.top_signals(counts, scope), scope, "top_offenders"),
        _top_list(watchlist, scope, "watchlist"),
        _top_list(first_severities, scope, "top_severities"),
        history,
        month_wide,
    ]


def _document(facility: Column, filename: str) -> Column:
    detection = F.col("mode") == "detection"
    period = F.format_string("%s %d-%02d", facility, F.col("file_year"), F.col("file_month"))
    summary = F.when(
        detection,
        F.concat(F.lit("Prioritized "), F.col("final_flags"), F.lit(" records for review for "), period, F.lit(".")),
    ).otherwise(F.concat(
        F.lit("Calibration report for "), period,
        F.lit("; history is not yet sufficient for record-level screening."),
    ))

    def pairs(rows: list[tuple[str, str]], first: str, second: str) -> Column:
        return F.array(*[F.struct(F.lit(a).alias(first), F.lit(b).alias(second)) for a, b in rows])

    def section(title: str, **fields: Column) -> Column:
        return F.struct(F.lit(title).alias("title"), *[c.alias(n) for n, c in fields.items()])

    col = F.col

    def listed(name: str) -> Column:
        return F.struct(F.lit(name).alias("list"), F.coalesce(F.try_element_at("list_rows", F.lit(name)), F.lit(0)).alias("rows"))

    distribution = section(
        "Screening Category Distribution", counts=col("diagnosis_counts"), confidence_counts=col("confidence_counts")
    )
    sections = {
        "executive_summary": section(
            "Executive Summary", mode=col("mode"), summary=summary,
            # Two kinds of rows may stand here, so the list is a variant.
            top_findings=F.when(F.size("top_severities") > 0, F.to_variant_object("top_severities")).otherwise(
                F.to_variant_object(F.slice("watchlist", 1, 8))
            ),
        ),
        "audit_trail": section(
            "Audit Trail", initial_flags=col("initial_flags"), seasonal_suppressed=col("seasonal_suppressed"),
            final_flags=col("final_flags"), mode=col("mode"),
        ),
        "facility_overview": section("Facility Overview", facility_metrics=col("facility_metrics")),
        "diagnosis_distribution": distribution,
        "recurring_signal_indicators": section(
            "Recurring Screening Signal Indicators", interpretation=F.lit(RECURRING_SECTION_TEXT),
            rows=listed("recurring_signal_indicators"),
        ),
        "screening_distribution": distribution,
        "top_offenders": section("Top Screening Signals by Society", rows=col("top_offenders")),
        "detail_logs": section("Detail Logs", rows=listed("detail_rows")),
        "action_plan": section("Action Plan", actions=pairs(ACTION_PLAN, "diagnosis", "action")),
        "methodology": section(
            "Methodology Summary", rules=pairs(RULE_TRIGGERS, "id", "trigger"),
            disabled_rules=pairs(DISABLED_RULES, "id", "reason"), intended_use=F.lit(DISCLAIMER),
            baseline_policy=F.struct(
                F.lit(LIMITS.min_prior_months).alias("minimum_total_prior_months"),
                F.lit(LIMITS.min_same_season_months).alias("minimum_same_season_prior_months"),
                col("mode").alias("mode"),
            ),
        ),
        "calibration": section(
            "Calibration / Insufficient History", watchlist=col("watchlist"),
            eligible_societies=F.coalesce("eligible_baseline_rows", F.lit(0)), baseline_snapshot=listed("historical_baselines"),
        ),
    }
    fields = {
        "methodology_version": F.lit(METHODOLOGY_VERSION),
        "disclaimer": F.lit(DISCLAIMER),
        "legacy_schema": F.struct(*[F.lit(v).alias(k) for k, v in LEGACY_FIELDS.items()]),
        "file_identity": F.struct(
            facility.alias("facility"), "facilities", "file_year", "file_month", col("run_season").alias("season"),
            F.lit(filename).alias("filename"),
        ),
        "processing_metrics": F.struct(
            "records_processed", col("distinct_dcs").alias("societies_active"),
            F.size("facilities").alias("facility_count"), F.lit(0).alias("duplicates_removed"),
            F.lit(0).alias("parse_warnings"), "mode",
        ),
        **{name: listed(name) for name in LISTS[:-1]},
        "sections": F.struct(*[c.alias(n) for n, c in sections.items()]),
        "retrieval": F.struct(
            summary.alias("summary_text"), col("diagnosis_counts").alias("top_diagnoses"),
            col("diagnosis_counts").alias("top_screening_categories"), col("mode").alias("mode"),
        ),
        "history_inputs": F.struct(
            F.coalesce("historical_month_stats_count", F.lit(0)).alias("historical_month_stats_count")
        ),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])
