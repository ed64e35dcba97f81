"""The steps that most queries share: statistics and baselines off sorted rows, scores and texts computed once."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pyarrow as pa
import pytest

from curdline.functions.expressions import fixed, stable_sql
from curdline.operators import arrow_groups as ag
from curdline.operators import baselines as bl
from curdline.operators import rules
from curdline.operators.month_stats import month_stats


def plan_of(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_stable_rounds_like_spark(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(-99, 99), 9) for _ in range(300)]
    values += [(a + b) / 2 for a, b in zip(values, values[1:])] + [rng.gauss(0, 40) for _ in range(300)]
    values += [0.0, -0.0, 5e-10, -5e-10, 1e-12, 1e15, 1.5e300, 123456.7890123455, float("inf"), -float("inf")]
    want = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").selectExpr("i", f"{stable_sql('v')} AS r")
    want = [r["r"] for r in sorted(want.collect())]
    assert ag.stable(np.array(values)).tolist() == want


@pytest.mark.parametrize("rows", [1, 4, 100])
def test_groups_that_batches_cut_are_put_together(rows):
    sizes = [1, 7, 2, 1, 5]
    keys = [("a", 1.0), ("a", None), (None, None), ("b", math.nan), ("b", 2.0)]
    texts = [k[0] for k, n in zip(keys, sizes) for _ in range(n)]
    numbers = pa.array([k[1] for k, n in zip(keys, sizes) for _ in range(n)], pa.float64())
    whole = pa.RecordBatch.from_arrays([pa.array(texts), numbers], names=["k", "x"])
    found = list(ag.whole_groups((whole.slice(i, 3) for i in range(0, len(texts), 3)), ["k", "x"], rows))
    assert pa.concat_batches(found).column("k").equals(whole.column("k"))
    assert [n for b in found for n in np.diff(np.append(ag.starts(b.columns), b.num_rows))] == sizes


def test_expanding_medians_sums_and_names():
    rng = random.Random(5)
    series = sorted(([rng.choice([None, 1.0, 2.5, 2.5, 7.0]) for _ in range(n)] for n in (1, 9, 4, 4, 12)), key=len, reverse=True)
    at = [(i, j) for i, s in enumerate(series) for j in range(len(s))]
    states = bl._Series(*(np.array(c) for c in zip(*at)), np.array([len(s) for s in series]))
    x = np.array([math.nan if series[i][j] is None else series[i][j] for i, j in at])
    for (i, j), median, total in zip(at, states.medians(x), states.sums(x), strict=True):
        known = [v for v in series[i][: j + 1] if v is not None]
        assert (median, total) == (statistics.median(known), sum(known)) if known else math.isnan(median) and math.isnan(total)
    assert bl._names_so_far(np.array([2, 1, 1, 0, 0, 2, 2, 3, 1]), np.array([0, 5, 7]), 3).tolist() == [2, 1, 1, 1, 0, 2, 2, 3, 1]


def test_statistics_hold_no_arrays_and_baselines_need_no_window(spark, records):
    """A row that held a society's months so far, for each of twelve medians, made the windows grow with the calendar."""
    stats = month_stats(records([{"file_month": m, "serial_no": i} for m in (4, 5, 6) for i in range(3)]))
    assert "collect_list" not in plan_of(stats)
    plan = plan_of(bl.baselines_by_period(spark.createDataFrame(stats.collect(), stats.schema)))
    assert "Window" not in plan and "collect_list" not in plan


def test_scores_and_outcomes_are_columns_of_generators(records, baselines):
    """Neither the filter on the rules nor the thin suppression holds their formulas again."""
    flagged = rules.apply_rules(records([{}]), baselines([{}]))
    plan = plan_of(flagged, "optimizedPlan")
    assert plan.count("Generate inline") == 2
    filters = [line for line in plan.splitlines() if "Filter" in line and rules.RULES["R1"] in line]
    assert filters and all("z_snf" not in line for line in filters)


@pytest.mark.parametrize("digits", [1, 2])
def test_fixed_point_text_near_halves_and_of_large_numbers(spark, digits):
    half = 0.5 / 10**digits
    values = [k / 10**digits + half + d for k in range(-30, 30) for d in (0.0, 1e-9, -1e-9, 1e-4)] + [999999.995, 1e6, 1234567.125, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed("v", digits).alias("text"))
    for r in df.collect():
        assert r["text"] == f"{r['v']:.{digits}f}"
