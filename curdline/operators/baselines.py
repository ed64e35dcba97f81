"""Baselines from strictly earlier months (A5-A9, J1) and from raw records (A10)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curdline.functions.expressions import month_index, season_of
from curdline.operators import arrow_groups as ag
from curdline.operators.group_summary import HOT_ROWS, summarize_groups
from curdline.operators.month_stats import clean_measures
from curdline.schema import ALL_YEAR, BASELINE_SUFFIXES, LIMITS, METRICS, SEASONS, SOCIETY, SUFFIXES


def baselines_by_period(stats: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Baselines of every society with earlier history, for every target month at once.

    A baseline changes only after a month in which the society (or its season) has records. So each row of
    ``stats`` gives one expanding state, and each target month takes the state in force just before it.
    There is no self-join and no pair of months: Spark deals and sorts the rows by society, once, and each task
    computes the states of many societies at a time. A society has at most one row per month of the calendar.
    """
    months = (stats if targets is None else targets).select(
        month_index(F.col("file_year"), F.col("file_month")).alias("ym")
    )
    calendar = months.agg(F.sort_array(F.collect_set("ym")).alias("calendar")).scalar()
    rows = stats.select(
        *SOCIETY, month_index(F.col("file_year"), F.col("file_month")).cast("bigint").alias("ym"), "season", "society_name",
        F.col("record_count").cast("bigint").alias("record_count"), *[F.col(c).cast("double").alias(c) for c in _INPUTS],
    )
    schema = T.StructType(
        [rows.schema[k] for k in SOCIETY] + [T.StructField(c, T.StringType()) for c in ["society_name", "season"]]
        + [T.StructField(c, T.LongType()) for c in _COUNTS] + [T.StructField(c, T.DoubleType()) for c in _OUTPUTS]
    )

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ag.whole_groups(batches, SOCIETY, SLAB):
            yield _baselines_of(batch).select(schema.names)

    dealt = rows.repartition(*SOCIETY).sortWithinPartitions(F.xxhash64(*SOCIETY), *SOCIETY, "ym")
    found = dealt.withColumn("calendar", calendar.cast("array<bigint>")).mapInArrow(states, schema)
    return _with_eligibility(found.withColumns({
        "file_year": F.floor(F.col("target") / 100).cast("int"), "file_month": (F.col("target") % 100).cast("int"),
    }))


#: Rows of month statistics that a task looks at together.
SLAB = 20_000
_MEDIANS = ["median", "q1", "q3"]
_AVERAGES = ["p90", "p10"]
_INPUTS = [f"{m}_{s}" for m in METRICS for s in BASELINE_SUFFIXES]
_OUTPUTS = _INPUTS
_COUNTS = ["record_count", "prior_month_count", "months", "summer_months", "winter_months", "target"]


def _baselines_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The baselines of whole societies whose rows come sorted by month, repeated for each target month."""
    size = batch.num_rows
    first = ag.starts([batch.column(k) for k in SOCIETY])
    society = np.repeat(np.arange(len(first)), np.diff(np.append(first, size)))
    ym = batch.column("ym").fill_null(-1).to_numpy(zero_copy_only=False)
    calendar = batch.column("calendar")[0].values.to_numpy(zero_copy_only=False).astype(np.int64)
    season, seasons = ag.ranked(batch.column("season"))
    known = seasons.to_pylist()
    count = ag.numbers(batch.column("record_count"))

    # Every row belongs to two series: its society's of all months, and that of its season.
    labels = pa.array([*known, ALL_YEAR, None], pa.string())
    everything = known.index(ALL_YEAR) if ALL_YEAR in known else len(known)
    group = np.concatenate([np.full(size, everything), np.where(season == len(known), len(known) + 1, season)])
    row = np.tile(np.arange(size), 2)
    order = np.lexsort((row, group, society[row]))
    row, group = row[order], group[order]
    head = np.flatnonzero(np.append(True, (society[row][1:] != society[row][:-1]) | (group[1:] != group[:-1])))
    length = np.diff(np.append(head, len(row)))
    # Longest series first, so that those with a k-th month are the first ones.
    by_length = np.argsort(-length, kind="stable")
    rank = np.empty_like(by_length)
    rank[by_length] = np.arange(len(by_length))
    series = np.repeat(rank, length)
    place = np.arange(len(row)) - np.repeat(head, length)
    states = _Series(series, place, length[by_length])

    out: dict[str, np.ndarray] = {}
    weight = count[row]
    for m in METRICS:
        mean, std = ag.numbers(batch.column(f"{m}_mean")), ag.numbers(batch.column(f"{m}_std"))
        shift = _first_known(mean, first)[row]
        terms = _pooling_terms(weight, mean[row], std[row], shift)
        out[f"{m}_mean"], out[f"{m}_std"] = _pooled(states, np.where(np.isnan(mean[row]), np.nan, weight), terms, shift)
        if m == "snf_pct":
            # A month takes part in the trim when its own mean lies between its own quartiles.
            q1, q3 = (ag.numbers(batch.column(f"snf_pct_{s}"))[row] for s in ["q1", "q3"])
            in_band = (mean[row] >= q1) & (mean[row] <= q3)
            kept = [np.where(in_band, t, np.nan) for t in (weight, *terms)]
            trim_mean, trim_std = _pooled(states, kept[0], kept[1:], shift)
            trim = (out["snf_pct_std"] > LIMITS.trim_std) & (states.sums(in_band * 1.0) >= LIMITS.trim_min_months)
            out["snf_pct_mean"] = np.where(trim, trim_mean, out["snf_pct_mean"])
            out["snf_pct_std"] = np.where(trim, trim_std, out["snf_pct_std"])
        for s in _MEDIANS:
            out[f"{m}_{s}"] = ag.stable(states.medians(ag.numbers(batch.column(f"{m}_{s}"))[row]))
        for s in _AVERAGES:
            x = ag.numbers(batch.column(f"{m}_{s}"))[row]
            with np.errstate(invalid="ignore", divide="ignore"):
                out[f"{m}_{s}"] = ag.stable(states.sums(x) / states.sums(~np.isnan(x) * 1.0))

    # A state is in force until the next month of its series. Of rows of one month the last one has all of them.
    of_row = season[row]
    counts = {
        "record_count": states.sums(weight), "months": place + 1.0,
        "summer_months": states.sums((of_row == _index(known, SEASONS[0])) * 1.0),
        "winter_months": states.sums((of_row == _index(known, SEASONS[1])) * 1.0),
    }
    after = np.searchsorted(calendar, ym[row], "right")
    until = np.append(after[1:], 0)
    until[np.append(head[1:], len(row)) - 1] = len(calendar)
    repeats = np.where(ym[row] < 0, 0, np.maximum(until - after, 0))
    at = np.repeat(np.arange(len(row)), repeats)
    target = calendar[after[at] + np.arange(len(at)) - np.repeat(np.cumsum(repeats) - repeats, repeats)]

    # Months before a target: places in the society's series of all months.
    overall = np.flatnonzero(group == everything)
    wide = max(int(calendar.max(initial=0)), int(ym.max())) + 2
    begin = np.searchsorted(society[row][overall], society[row][at])
    prior = np.searchsorted(society[row][overall] * wide + ym[row][overall] + 1, society[row][at] * wide + target + 1) - begin

    places, names = ag.ranked(batch.column("society_name"))
    columns = {k: batch.column(k).take(pa.array(row[at])) for k in SOCIETY}
    columns["society_name"] = ag.named(_names_so_far(places[row], head, len(names))[at], names)
    columns["season"] = labels.take(pa.array(group[at]))
    for name, x in counts.items():
        columns[name] = pa.array(np.nan_to_num(x[at]).astype(np.int64), mask=np.isnan(x[at]))
    columns |= {"prior_month_count": pa.array(prior), "target": pa.array(target)}
    columns |= {c: ag.doubles(out[c][at]) for c in _OUTPUTS}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _index(values: list, value) -> int:
    return values.index(value) if value in values else -1


def _first_known(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each row the first known value of its group up to this row."""
    at = np.where(np.isnan(x), len(x), np.arange(len(x)))
    known = np.repeat(np.minimum.reduceat(at, first), np.diff(np.append(first, len(x))))
    return np.where(known <= np.arange(len(x)), np.append(x, np.nan)[known], np.nan)


class _Series:
    """Many series of months, side by side in matrices: rows are series, the longest first, columns are places."""

    def __init__(self, series: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> None:
        self.at = (series, place)
        self.shape = (len(lengths), int(lengths[0]))
        #: How many series have a month at each place.
        self.active = np.searchsorted(-lengths, -np.arange(self.shape[1]), "left")

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Expanding sums of the known values, added in the order of the months; NaN before the first one."""
        whole = np.zeros(self.shape)
        known = np.zeros(self.shape, bool)
        whole[self.at] = np.where(np.isnan(x), 0.0, x)
        known[self.at] = ~np.isnan(x)
        return np.where(np.logical_or.accumulate(known, 1), np.cumsum(whole, 1), np.nan)[self.at]

    def medians(self, x: np.ndarray) -> np.ndarray:
        """Expanding medians of the known values; NaN before the first one.

        Each series' values so far are kept sorted, missing ones at the end: a value moves into its place by a
        minimum and a maximum with the sorted values and the same shifted by one.
        """
        values = np.full(self.shape, np.inf)
        values[self.at] = np.where(np.isnan(x), np.inf, x)
        n = np.zeros(self.shape, np.int64)
        n[self.at] = ~np.isnan(x)
        n = np.cumsum(n, 1)
        so_far = np.full((self.shape[0], self.shape[1] + 1), np.inf)
        so_far[:, 0] = -np.inf
        out = np.full(self.shape, np.nan)
        for k, own in enumerate(self.active):
            so_far[:own, 1 : k + 2] = np.maximum(so_far[:own, : k + 1], np.minimum(so_far[:own, 1 : k + 2], values[:own, k, None]))
            known = n[:own, k]
            rows = np.arange(own)
            middle = (so_far[rows, 1 + np.maximum(known - 1, 0) // 2] + so_far[rows, 1 + known // 2]) / 2
            out[:own, k] = np.where(known > 0, middle, np.nan)
        return out[self.at]


def _names_so_far(places: np.ndarray, head: np.ndarray, absent: int) -> np.ndarray:
    """Of each row the most frequent name of its series up to this row, the smallest one on ties; none: ``absent``."""
    low = np.minimum.reduceat(places, head)
    high = np.maximum.reduceat(places, head)
    out = places.copy()
    ends = np.append(head[1:], len(places))
    for i in np.flatnonzero(low != high):
        seen: Counter[int] = Counter()
        best = absent
        for j in range(head[i], ends[i]):
            name = int(places[j])
            if name != absent:
                seen[name] += 1
                if best == absent or (-seen[name], name) < (-seen[best], best):
                    best = name
            out[j] = best
    return out


def _pooling_terms(weight: np.ndarray, mean: np.ndarray, std: np.ndarray, shift: np.ndarray) -> list[np.ndarray]:
    """Summands of a pooled mean and variance, as deviations from the society's first monthly mean."""
    away = mean - shift
    spread = np.where(np.isnan(std), 0.0, std)
    return [weight * away, weight * away * away, np.fmax(weight - 1, 0) * spread * spread]


def _pooled(states: _Series, weight: np.ndarray, terms: list[np.ndarray], shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled mean and std of each state. A month without a value of this measure has no weight in it."""
    n, s1, s2, within = (states.sums(x) for x in (weight, *terms))
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, shift + s1 / n, np.nan)
        std = np.sqrt((within + np.maximum(s2 - s1 * s1 / n, 0.0)) / (n - 1))
        return ag.stable(mean), ag.stable(np.where(n > 1, std, np.where(n > 0, 0.0, np.nan)))


def _with_eligibility(rows: DataFrame) -> DataFrame:
    is_all = f"season = '{ALL_YEAR}'"
    same_season = (
        F.when(F.expr(f"NOT {is_all}"), F.col("months"))
        .when(season_of(F.col("file_month")) == "summer", F.col("summer_months"))
        .otherwise(F.col("winter_months"))
    )
    counted = rows.withColumn("same_season_prior_month_count", same_season)
    eligible = (
        f"prior_month_count >= {LIMITS.min_prior_months} AND "
        f"({is_all} OR same_season_prior_month_count >= {LIMITS.min_same_season_months})"
    )
    return counted.selectExpr(
        *SOCIETY, "society_name", "season", "record_count", "prior_month_count", "same_season_prior_month_count",
        f"int({eligible}) AS eligible", *[f"{m}_{s}" for m in METRICS for s in BASELINE_SUFFIXES],
        "file_year", "file_month",
    )


def baselines_for_period(stats: DataFrame, year: int, month: int) -> DataFrame:
    """Baselines of one target month; only earlier months are read."""
    target = year * 100 + month
    earlier = stats.where(month_index(F.col("file_year"), F.col("file_month")) < target)
    wanted = stats.sparkSession.range(1).select(F.lit(year).alias("file_year"), F.lit(month).alias("file_month"))
    return baselines_by_period(earlier, wanted)


def baselines_from_records(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Baselines straight from records: per season and all year, groups of at least ten rows, always eligible."""
    grouped = clean_measures(records).withColumn("season", F.explode(F.array(F.col("season"), F.lit(ALL_YEAR))))
    keys = [*SOCIETY, "season"]
    summary = summarize_groups(grouped, keys, {"record_count": F.lit(True)}, hot_rows=hot_rows, trim=True)
    trim = (F.col("snf_pct_std") > LIMITS.trim_std) & (F.col("snf_trim_count") >= LIMITS.trim_min_records)
    return (
        summary.where(F.col("record_count") >= LIMITS.raw_baseline_min_records)
        .withColumns({
            "snf_pct_mean": F.when(trim, F.col("snf_trim_mean")).otherwise(F.col("snf_pct_mean")),
            "snf_pct_std": F.when(trim, F.col("snf_trim_std")).otherwise(F.col("snf_pct_std")),
            "eligible": F.lit(1),
        })
        .select(*SOCIETY, "society_name", "season", "record_count", "eligible",
                *[f"{m}_{s}" for m in METRICS for s in SUFFIXES])
    )
