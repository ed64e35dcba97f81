"""Shared events: many societies of one shift moving the same way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curdline.schema import EVENT_KEYS, FLAG_COLUMNS, LIMITS


def active_societies(records: DataFrame) -> DataFrame:
    """Distinct societies per shift. Spark deduplicates (shift, society) before it counts, on both sides of
    the shuffle, so a crowded shift is never one task."""
    return records.groupBy(*EVENT_KEYS).agg(F.countDistinct("dcs").alias("total_active"))


def direction() -> Column:
    down = (F.col("z_snf") < -1) | (F.col("z_fat") < -1) | (F.col("z_clr") < -1)
    up = (F.col("z_snf") > 1) | (F.col("z_clr") > 1)
    return F.when(down, "down").when(up, "up").otherwise("mixed")


def _is_event(pct: Column) -> Column:
    return F.coalesce((pct > LIMITS.shared_event_pct).cast("int"), F.lit(0))


def shared_event_shares(directed: DataFrame, active: DataFrame) -> DataFrame:
    """Per shift and direction: flagged societies, active societies, percentage, event flag."""
    moved = directed.groupBy(*EVENT_KEYS, "direction").agg(F.countDistinct("dcs").alias("num_dir"))
    return (
        moved.join(active, EVENT_KEYS, "left")
        .withColumn("pct_flagged", F.col("num_dir") / F.col("total_active") * 100)
        .withColumn("seasonal_likely", _is_event(F.col("pct_flagged")))
    )


def mark_shared_events(flags: DataFrame, records: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Flags with their direction and the share of active societies that moved with them.

    Both counts are joined first (small tables); the flags themselves are joined once. ``active`` are the records'
    active societies where the caller has them stored.
    """
    directed = flags.withColumn("direction", direction())
    shares = shared_event_shares(directed, active_societies(records) if active is None else active)
    return directed.join(shares, [*EVENT_KEYS, "direction"], "left").withColumn(
        "seasonal_likely", F.coalesce("seasonal_likely", F.lit(0))
    )


def ordered_flags(flags: DataFrame) -> DataFrame:
    return flags.select(*FLAG_COLUMNS)


def reportable(flags: DataFrame) -> DataFrame:
    return flags.where(F.col("seasonal_likely") == 0)


def daily_summary(flags: DataFrame, active: DataFrame) -> DataFrame:
    """Every shift with records; suppressed flags count and the direction does not matter."""
    flagged = flags.groupBy(*EVENT_KEYS).agg(F.countDistinct("dcs").alias("num_flagged"))
    return (
        active.join(flagged, EVENT_KEYS, "left")
        .withColumn("num_flagged", F.coalesce("num_flagged", F.lit(0).cast("bigint")))
        .withColumn("pct_flagged", F.col("num_flagged") / F.col("total_active") * 100)
        .withColumn("seasonal_event", _is_event(F.col("pct_flagged")))
        .select(*EVENT_KEYS, "total_active", "num_flagged", "pct_flagged", "seasonal_event")
    )
