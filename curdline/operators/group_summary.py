"""Exact order statistics per group, safe for groups of any size (A2, A4).

Most groups are small (a society files about sixty deliveries a month): Spark deals and sorts the rows by their group,
and each task reads the statistics of many groups at a time off Arrow batches. A group above the row limit is never
held in one piece. It is counted per distinct value, cut into value buckets, and the wanted ranks are looked up in the
buckets that hold them; every step is an aggregate with map-side combine or a window over one bucket.

A group counts as large above ``HOT_ROWS`` rows, whatever the size of the whole table. The list of large groups is
broadcast; as each stands for more than HOT_ROWS rows, a million million rows give fewer than a million of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curdline.functions.expressions import all_of, most_frequent_by, stable_sql
from curdline.operators import arrow_groups as ag
from curdline.schema import METRICS

HOT_ROWS = 1_000_000
BUCKETS_PER_UNIT = 128
#: Rows of small groups that a task looks at together.
SLAB = 100_000
QUANTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75, "p90": 0.9, "p10": 0.1}


def summarize_groups(
    df: DataFrame,
    keys: list[str],
    counts: dict[str, Column],
    least: list[str] = (),
    hot_rows: int = HOT_ROWS,
    trim: bool = False,
) -> DataFrame:
    """One row per group: counts and least texts, society name (mode) and the nine statistics of each measure.

    ``counts`` are conditions whose rows are counted, ``least`` text columns whose first value is wanted. Further
    columns: ``snf_above_p90`` (rows above the group's own p90) and, with ``trim``, ``snf_trim_count/mean/std`` (rows
    within the group's own [q1, q3]).
    """
    df = df.where(all_of([F.col(k).isNotNull() for k in keys]))
    hot = large_groups(df, keys, hot_rows)
    small = df.join(F.broadcast(hot), keys, "left_anti")
    large = df.join(F.broadcast(hot), keys, "left_semi")
    extras = {name: F.count_if(c) for name, c in counts.items()} | {name: F.min(name) for name in least}
    return _summarize_small(small, keys, counts, least, trim).unionByName(_summarize_large(large, keys, extras, trim))


def large_groups(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") > hot_rows).select(*keys)


def _moments() -> list[Column]:
    out = []
    for m in METRICS:
        out += [
            F.expr(f"avg({m}) AS {m}_mean"),
            F.expr(f"CASE WHEN count({m}) > 0 THEN coalesce(stddev_samp({m}), 0D) END AS {m}_std"),
            F.expr(f"min({m}) AS {m}_min"),
            F.expr(f"max({m}) AS {m}_max"),
        ]
    return out


def _finished(df: DataFrame, keys: list[str], extras: dict[str, Column], trim: bool) -> DataFrame:
    noisy = [f"{m}_{s}" for m in METRICS for s in ["mean", "std", *QUANTILES, "min", "max"]]
    more = ["snf_above_p90"]
    if trim:
        noisy += ["snf_trim_mean", "snf_trim_std"]
        more.append("snf_trim_count")
    return df.selectExpr(*keys, *extras, "society_name", *[f"{stable_sql(c)} AS {c}" for c in noisy], *more)


def _moments_from_sums(df: DataFrame, prefix: str, n: str, shift: str) -> DataFrame:
    """Mean and sample std from sums of deviations from ``shift`` (precise when that is near the mean)."""
    s1, s2 = f"{prefix}s1", f"{prefix}s2"
    std = f"CASE WHEN {n} > 1 THEN sqrt(greatest({s2} - {s1} * {s1} / {n}, 0D) / ({n} - 1)) WHEN {n} = 1 THEN 0D END"
    return df.withColumns({
        f"{prefix}mean": F.expr(f"CASE WHEN {n} > 0 THEN {shift} + {s1} / {n} END"),
        f"{prefix}std": F.expr(std),
    })


def _summarize_small(df: DataFrame, keys: list[str], counts: dict[str, Column], least: list[str], trim: bool) -> DataFrame:
    """Bounded groups: the rows of each one come together once, sorted by its keys.

    Sums run over sorted values, so the result does not depend on the order in which rows arrive.
    """
    rows = df.select(
        *keys, *METRICS, "society_name", *least, *[F.coalesce(c, F.lit(False)).alias(name) for name, c in counts.items()]
    )
    texts = ["society_name", *least]
    statistics = [f"{m}_{s}" for m in METRICS for s in ["mean", "std", *QUANTILES, "min", "max"]]
    whole = [*counts, "snf_above_p90"]
    if trim:
        statistics += ["snf_trim_mean", "snf_trim_std"]
        whole.append("snf_trim_count")
    schema = T.StructType(
        [df.schema[k] for k in keys] + [T.StructField(c, T.LongType()) for c in whole]
        + [T.StructField(c, T.StringType()) for c in texts] + [T.StructField(c, T.DoubleType()) for c in statistics]
    )
    counted = list(counts)

    def summarized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ag.whole_groups(batches, keys, SLAB):
            first = ag.starts([batch.column(k) for k in keys])
            out: dict[str, pa.Array] = {k: _key(batch.column(k).take(pa.array(first))) for k in keys}
            for name in counted:
                marked = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                out[name] = pa.array(np.add.reduceat(marked, first))
            places, names = ag.ranked(batch.column("society_name"))
            out["society_name"] = ag.named(_modes(places, first, len(names)), names)
            for name in least:
                places, names = ag.ranked(batch.column(name))
                out[name] = ag.named(np.minimum.reduceat(places, first), names)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, batch.num_rows)))
            for m in METRICS:
                found, more = _order_statistics(ag.numbers(batch.column(m)), group, first, trim)
                out |= {f"{m}_{s}": ag.doubles(ag.stable(x)) for s, x in found.items() if not s.startswith("trim")}
                if m == "snf_pct":
                    out |= {f"snf_{s}": pa.array(x) for s, x in more.items()}
                    out |= {f"snf_{s}": ag.doubles(ag.stable(x)) for s, x in found.items() if s.startswith("trim")}
            yield pa.RecordBatch.from_arrays([out[f] for f in schema.names], names=schema.names)

    # Nearly all comparisons end at the hash, a fixed-width prefix; the keys tell groups of one hash apart.
    return rows.repartition(*keys).sortWithinPartitions(F.xxhash64(*keys), *keys).mapInArrow(summarized, schema)


def _key(column: pa.Array) -> pa.Array:
    """A key as Spark groups it: no negative zero."""
    return pa.array(ag.numbers(column) + 0.0, column.type) if pa.types.is_floating(column.type) else column


def _modes(places: np.ndarray, first: np.ndarray, absent: int) -> np.ndarray:
    """Of each group its most frequent place, the smallest one on ties; ``absent`` does not count."""
    low = np.minimum.reduceat(places, first)
    high = np.maximum.reduceat(np.where(places == absent, -1, places), first)
    mixed = (low != high) & (high >= 0)
    if mixed.any():
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(places))))
        open_ = mixed[group] & (places != absent)
        pairs, n = np.unique(group[open_] * (absent + 1) + places[open_], return_counts=True)
        of, place = pairs // (absent + 1), pairs % (absent + 1)
        order = np.lexsort((place, -n, of))
        at = order[np.unique(of[order], return_index=True)[1]]
        low[of[at]] = place[at]
    return low


def _order_statistics(
    values: np.ndarray, group: np.ndarray, first: np.ndarray, trim: bool
) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Statistics of each group's values (NaN: missing), null as NaN; counts of the values above p90 and within [q1, q3]."""
    order = np.lexsort((values, group))  # missing ones last
    values = values[order]
    present = ~np.isnan(values)
    n = np.bincount(group, present).astype(np.int64)
    last = len(values) - 1

    def at(place: np.ndarray) -> np.ndarray:
        return np.where(n > 0, values[np.minimum(first + np.maximum(place, 0), last)], np.nan)

    def sums(prefix: str, chosen: np.ndarray, total: np.ndarray, shift: np.ndarray) -> dict[str, np.ndarray]:
        """Mean and sample std from sums of deviations from ``shift``, added in the order of the values."""
        away = np.where(chosen, values - shift[group], 0.0)
        s1, s2 = np.bincount(group, away), np.bincount(group, away * away)
        mean = np.where(total > 0, shift + s1 / total, np.nan)
        std = np.sqrt(np.maximum(s2 - s1 * s1 / total, 0.0) / (total - 1))
        return {f"{prefix}mean": mean, f"{prefix}std": np.where(total > 1, std, np.where(total == 1, 0.0, np.nan))}

    with np.errstate(invalid="ignore", divide="ignore"):
        found = {"min": at(np.zeros_like(n)), "max": at(n - 1)}
        for s, q in QUANTILES.items():
            position = (n - 1) * q
            low = np.floor(position).astype(np.int64)
            a, b = at(low), at(np.minimum(low + 1, n - 1))
            found[s] = a + (b - a) * (position - np.floor(position))
        found |= sums("", present, n, at(n // 2))
        below = at(np.floor((n - 1) * QUANTILES["p90"]).astype(np.int64))
        more = {"above_p90": np.bincount(group, values > below[group]).astype(np.int64)}
        if trim:
            kept = (values >= found["q1"][group]) & (values <= found["q3"][group])
            more["trim_count"] = np.bincount(group, kept).astype(np.int64)
            found |= sums("trim_", kept, more["trim_count"], found["median"])
    return found, more


def _summarize_large(df: DataFrame, keys: list[str], extras: dict[str, Column], trim: bool) -> DataFrame:
    base = df.groupBy(*keys).agg(*[c.alias(name) for name, c in extras.items()], *_moments())
    names = (
        df.groupBy(*keys, "society_name").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys).agg(most_frequent_by(F.col("n"), F.col("society_name")).alias("society_name"))
    )
    values = _value_counts(df, keys)
    ranked = _quantiles_by_rank(values, keys)
    joined = base.join(names, keys, "left").join(ranked, keys, "left")
    if trim:
        joined = joined.join(_trim_sums_by_value(values, ranked, keys), keys, "left")
        joined = _moments_from_sums(joined, "snf_trim_", "snf_trim_count", "snf_pct_median")
    return _finished(joined, keys, extras, trim)


def _value_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values with counts; a hot group is spread over its values before it is shuffled."""
    long = df.unpivot(keys, METRICS, "metric", "value").where("value IS NOT NULL")
    return (
        long.groupBy(*keys, "metric", "value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.expr(f"floor(value * {BUCKETS_PER_UNIT})"))
    )


def _quantiles_by_rank(values: DataFrame, keys: list[str]) -> DataFrame:
    by_metric = [*keys, "metric"]
    up_to_here = Window.partitionBy(*by_metric).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = (
        values.groupBy(*by_metric, "bucket").agg(F.sum("n").alias("bucket_n"))
        .withColumn("bucket_end", F.sum("bucket_n").over(up_to_here))
        .withColumn("total", F.sum("bucket_n").over(Window.partitionBy(*by_metric)))
    )

    # Ranks count from 0. A quantile lies between two neighbouring ranks, its low and its high one.
    low = {s: f"floor((total - 1) * {q}D)" for s, q in QUANTILES.items()}
    high = {s: f"least({low[s]} + 1, total - 1)" for s in QUANTILES}
    wanted = ", ".join([*low.values(), *high.values()])
    located = buckets.where(
        f"exists(array({wanted}), r -> r >= bucket_end - bucket_n AND r < bucket_end)"
    ).selectExpr(*by_metric, "bucket", "bucket_end - bucket_n AS bucket_start", "total")

    in_bucket = Window.partitionBy(*by_metric, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.join(located, [*by_metric, "bucket"]).withColumn(
        "end", F.col("bucket_start") + F.sum("n").over(in_bucket)
    )

    def at(rank: str) -> str:
        return f"{rank} >= end - n AND {rank} < end"

    picks = [F.expr(f"max(total) FILTER (WHERE metric = '{m}') AS {m}_total") for m in METRICS]
    picks += [
        F.expr(f"max(value) FILTER (WHERE metric = '{m}' AND {at(rank[s])}) AS {m}_{s}_{side}")
        for m in METRICS for s in QUANTILES for side, rank in [("low", low), ("high", high)]
    ]
    picks.append(F.expr(f"max(total - end) FILTER (WHERE metric = 'snf_pct' AND {at(low['p90'])}) AS snf_above_p90"))

    def interpolated(m: str, s: str, q: float) -> str:
        position = f"(({m}_total - 1) * {q}D)"
        return f"{m}_{s}_low + ({m}_{s}_high - {m}_{s}_low) * ({position} - floor({position})) AS {m}_{s}"

    return placed.groupBy(*keys).agg(*picks).selectExpr(
        *keys, *[interpolated(m, s, q) for m in METRICS for s, q in QUANTILES.items()],
        "coalesce(snf_above_p90, 0L) AS snf_above_p90",
    )


def _trim_sums_by_value(values: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    bounds = ranked.select(*keys, "snf_pct_q1", "snf_pct_q3", "snf_pct_median")
    snf = values.where("metric = 'snf_pct'").join(bounds, keys).where("value BETWEEN snf_pct_q1 AND snf_pct_q3")
    return snf.withColumn("away", F.expr("value - snf_pct_median")).groupBy(*keys).agg(
        F.sum("n").alias("snf_trim_count"), F.expr("sum(n * away) AS snf_trim_s1"),
        F.expr("sum(n * away * away) AS snf_trim_s2"),
    )
