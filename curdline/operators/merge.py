"""Unions, keyed merges and period bookkeeping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curdline.schema import BATCH_FACILITY, PERIOD


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. Null keys compare equal; copies are cut down before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(window)).where(F.col("_place") == 1).drop("_place")


def keyed_merge(
    existing: DataFrame, new: DataFrame, keys: list[str], preserve_existing: bool = False,
    tie_break: list[str] | None = None,
) -> DataFrame:
    """New rows replace existing ones with the same key, or the other way round.

    Duplicates within one side are reduced too; which of them stays depends only on their values.
    """
    old_side, new_side = (0, 1) if preserve_existing else (1, 0)
    both = existing.withColumn("_side", F.lit(old_side)).unionByName(
        new.withColumn("_side", F.lit(new_side)), allowMissingColumns=True
    )
    rest = tie_break or [c for c in new.columns if c not in keys]
    return distinct_by(both, keys, [F.col("_side"), *[F.col(c) for c in rest]]).drop("_side")


def completed_periods(bundles: DataFrame) -> DataFrame:
    return bundles.select(*PERIOD).dropna().distinct()


def _done(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    done = completed_periods(bundles)
    whole_months = done.where(F.col("facility") == BATCH_FACILITY).select("file_year", "file_month").distinct()
    return done, whole_months


def only_new_periods(records: DataFrame, bundles: DataFrame) -> DataFrame:
    """Records of periods without a bundle; an ALL bundle completes the month for every facility."""
    done, whole_months = _done(bundles)
    return records.join(done, PERIOD, "left_anti").join(whole_months, ["file_year", "file_month"], "left_anti")


def skipped_periods(records: DataFrame, bundles: DataFrame) -> DataFrame:
    """Periods of the input that are already done, with their printed form."""
    periods = records.select(*PERIOD).distinct()
    fresh = only_new_periods(periods, bundles)
    label = F.format_string("%s:%04d-%02d", "facility", "file_year", "file_month")
    return periods.join(fresh, PERIOD, "left_anti").withColumn("period", label)


def duplicate_period(bundles: DataFrame, facility: str, year: int, month: int) -> bool:
    """Whether a bundle of this period exists (reads one matching row at most)."""
    same = (F.col("facility") == facility) & (F.col("file_year") == year) & (F.col("file_month") == month)
    return not bundles.where(same).limit(1).isEmpty()


def single_period(records: DataFrame) -> tuple[int, int]:
    """Year and month of a batch; an error if its records belong to several months."""
    found = records.select("file_year", "file_month").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("All files of a batch must belong to the same month and year.")
    return found[0]["file_year"], found[0]["file_month"]
