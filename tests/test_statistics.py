"""Statistics and baselines against plain NumPy on small frames."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest

from curdline.functions.expressions import fixed
from curdline.operators import baselines as bl
from curdline.operators.month_stats import month_stats
from curdline.schema import METRICS, SUFFIXES


def some_rows(seed=1, hot=0):
    rng = random.Random(seed)
    rows = []
    for month in range(1, 9):
        for dcs in (101.0, 102.0, 103.5):
            n = rng.choice([1, 2, 3, 12, 40]) + (hot if dcs == 101.0 else 0)
            for i in range(n):
                rows.append({
                    "dcs": dcs, "society_name": rng.choice(["Zeta", "Alpha"]), "serial_no": i,
                    "date": dt.date(2025, month, 1), "shift": rng.choice("ME"), "file_month": month,
                    "season": "summer" if 4 <= month <= 9 else "winter",
                    "qty": rng.choice([5.0, 60.0, 61.5, 300.0]), "fat_pct": round(rng.gauss(5, 1), 3),
                    "snf_pct": round(rng.gauss(8.6, 0.9), 1), "clr": None if rng.random() < 0.1 else round(rng.gauss(28, 2), 2),
                })
    return rows


def summary(values):
    v = np.array([x for x in values if x is not None])
    if not len(v):
        return {}
    return {"mean": v.mean(), "std": v.std(ddof=1) if len(v) > 1 else 0.0, "median": np.median(v), "min": v.min(), "max": v.max(),
            **{s: np.quantile(v, q) for s, q in [("q1", 0.25), ("q3", 0.75), ("p90", 0.9), ("p10", 0.1)]}}


def grouped(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


def mode(values):
    return min(set(values), key=lambda v: (-values.count(v), v))


def near(a, b):
    return a == b if a is None or b is None else math.isclose(a, b, abs_tol=2e-9, rel_tol=1e-12)


@pytest.mark.parametrize("hot_rows", [100_000, 10])
def test_month_stats_for_small_and_large_groups(records, hot_rows):
    """With a low limit every group takes the way of the large ones; the numbers stay the same."""
    rows = some_rows(hot=30)
    got = {(r["dcs"], r["file_month"]): r for r in month_stats(records(rows), hot_rows=hot_rows).collect()}
    wanted = grouped(rows, "dcs", "file_month")
    assert set(got) == set(wanted)
    for key, group in wanted.items():
        r = got[key]
        assert r["record_count"] == len(group)
        assert r["morning_count"] == sum(g["shift"] == "M" for g in group)
        assert r["evening_count"] == sum(g["shift"] == "E" for g in group)
        assert r["low_qty_count"] == sum(g["qty"] < 10 for g in group)
        assert r["society_name"] == mode([g["society_name"] for g in group])
        snf = [g["snf_pct"] for g in group]
        assert r["high_snf_spike_count"] == sum(x > np.quantile(snf, 0.9) + 1e-12 for x in snf)
        for m in METRICS:
            want = summary([g[m] for g in group])
            for s in SUFFIXES:
                assert near(r[f"{m}_{s}"], want.get(s)), (key, m, s, r[f"{m}_{s}"], want.get(s))


def test_many_names_in_one_group(records):
    """The state of the most frequent name is linear in the names: misspelled ones cost no more than others."""
    rows = [{"serial_no": i, "society_name": f"name {i % 50_000}"} for i in range(50_001)]
    r = month_stats(records(rows)).first()
    assert (r["society_name"], r["record_count"]) == ("name 0", 50_001)


def test_nan_and_infinity_count_as_missing(records):
    rows = [{"qty": float("nan")}, {"qty": float("inf")}, {"qty": 4.0}]
    r = month_stats(records(rows)).first()
    assert (r["qty_mean"], r["qty_std"], r["qty_max"], r["record_count"], r["low_qty_count"]) == (4.0, 0.0, 4.0, 3, 1)


@pytest.mark.parametrize("hot_rows", [100_000, 0])
def test_baselines_from_records(records, hot_rows):
    rows = some_rows(seed=5)
    got = {(r["dcs"], r["season"]): r for r in bl.baselines_from_records(records(rows), hot_rows).collect()}
    wanted = grouped(rows, "dcs", "season") | {(k[0], "all"): g for k, g in grouped(rows, "dcs").items()}
    wanted = {k: g for k, g in wanted.items() if len(g) >= 10}
    assert set(got) == set(wanted)
    trimmed = 0
    for key, group in wanted.items():
        for m in METRICS:
            want = summary([g[m] for g in group])
            if m == "snf_pct" and want["std"] > 0.5:
                kept = [g[m] for g in group if want["q1"] <= g[m] <= want["q3"]]
                if len(kept) >= 5:
                    want |= {k: summary(kept)[k] for k in ("mean", "std")}
                    trimmed += 1
            for s in SUFFIXES:
                assert near(got[key][f"{m}_{s}"], want[s]), (key, m, s)
    assert trimmed


def pooled(group, m):
    group = [g for g in group if g[f"{m}_mean"] is not None]
    if not group:
        return None, None
    n = np.array([g["record_count"] for g in group], float)
    means, stds = (np.array([g[f"{m}_{s}"] for g in group], float) for s in ("mean", "std"))
    mean = np.average(means, weights=n)
    total = n.sum()
    if total <= 1:
        return mean, 0.0
    return mean, math.sqrt((np.maximum(n - 1, 0) * stds**2 + n * (means - mean) ** 2).sum() / max(total - 1, 1))


def check_baselines(stats_rows, got, targets):
    expected = {}
    for target in targets:
        earlier = [s for s in stats_rows if s["file_year"] * 100 + s["file_month"] < target]
        for (facility, dcs), months in grouped(earlier, "facility", "dcs").items():
            seasons = grouped(months, "season")
            for season, group in [("all", months), *[(k[0], g) for k, g in seasons.items()]]:
                own = "summer" if 4 <= target % 100 <= 9 else "winter"
                same = len(seasons.get((own,), [])) if season == "all" else len(group)
                expected[(facility, dcs, season, target)] = (group, len(months), same)
    found = {(r["facility"], r["dcs"], r["season"], r["file_year"] * 100 + r["file_month"]): r for r in got}
    assert len(found) == len(got) and set(found) == set(expected)
    trimmed = 0
    for key, (group, prior, same) in expected.items():
        r = found[key]
        assert (r["prior_month_count"], r["same_season_prior_month_count"]) == (prior, same)
        assert r["eligible"] == int(prior >= 3 and (key[2] == "all" or same >= 2))
        assert r["record_count"] == sum(g["record_count"] for g in group)
        assert r["society_name"] == mode([g["society_name"] for g in group])
        for m in METRICS:
            mean, std = pooled(group, m)
            if m == "snf_pct" and round(std, 9) > 0.5:
                kept = [g for g in group if g["snf_pct_q1"] <= g["snf_pct_mean"] <= g["snf_pct_q3"]]
                if len(kept) >= 2:
                    mean, std = pooled(kept, m)
                    trimmed += 1
            if mean is None:
                assert r[f"{m}_mean"] is r[f"{m}_std"] is r[f"{m}_median"] is r[f"{m}_p90"] is None
                continue
            assert near(r[f"{m}_mean"], mean) and math.isclose(r[f"{m}_std"], std, abs_tol=1e-8), (key, m, r[f"{m}_std"], std)
            known = [g for g in group if g[f"{m}_mean"] is not None]
            for s in ("median", "q1", "q3"):
                assert near(r[f"{m}_{s}"], statistics.median(g[f"{m}_{s}"] for g in known))
            for s in ("p90", "p10"):
                assert near(r[f"{m}_{s}"], np.mean([g[f"{m}_{s}"] for g in known]))
    return trimmed


def test_baselines_of_all_targets_at_once(spark, records):
    rows = some_rows(seed=3)
    rows = [{**r, "clr": None if r["file_month"] in (1, 5) or r["dcs"] == 103.5 else r["clr"]} for r in rows]
    rows = [r for r in rows if not (r["dcs"] == 102.0 and r["file_month"] in (3, 4, 6))]
    stats = month_stats(records(rows)).cache()
    plain = [r.asDict() for r in stats.collect()]
    targets = sorted({s["file_year"] * 100 + s["file_month"] for s in plain})
    assert check_baselines(plain, bl.baselines_by_period(stats).collect(), targets)
    later = spark.createDataFrame([(2025, 7), (2026, 2)], "file_year int, file_month int")
    check_baselines(plain, bl.baselines_by_period(stats, later).collect(), [202507, 202602])


def test_one_target_at_a_time_gives_the_same(records):
    stats = month_stats(records(some_rows(seed=4))).cache()
    whole = {tuple(r) for r in bl.baselines_by_period(stats).collect()}
    single = {tuple(r) for m in range(1, 9) for r in bl.baselines_for_period(stats, 2025, m).collect()}
    assert whole == single


def test_duplicated_months_count_as_rows(records):
    stats = month_stats(records(some_rows(seed=6))).where("dcs = 101.0 AND file_month <= 3")
    twice = stats.unionByName(stats)
    r = bl.baselines_for_period(twice, 2025, 5).where("season = 'all'").first()
    assert r["prior_month_count"] == 6 and r["same_season_prior_month_count"] == 0


def test_months_without_values_have_no_weight(records):
    rows = [{"file_month": m, "serial_no": i, "clr": c} for m, c in [(4, 27.0), (5, None), (6, 30.0)] for i in range(10)]
    r = bl.baselines_for_period(month_stats(records(rows)), 2025, 7).where("season = 'all'").first()
    assert (r["clr_mean"], r["record_count"]) == (28.5, 30)


def test_eligibility_with_three_summer_months(records):
    rows = [{"file_month": m, "serial_no": i} for m, n in [(4, 10), (5, 12), (6, 14)] for i in range(n)]
    r = bl.baselines_for_period(month_stats(records(rows)), 2025, 7).where("season = 'summer'").first()
    assert (r["prior_month_count"], r["same_season_prior_month_count"], r["eligible"], r["record_count"]) == (3, 3, 1, 36)
    assert r["snf_pct_std"] == 0.0 and r["snf_pct_mean"] == 8.75


@pytest.mark.parametrize("digits", [1, 2])
def test_fixed_point_text_like_printf(spark, digits):
    rng = random.Random(7)
    values = [0.0, 0.005, 0.015, 0.035, 0.0549999, 0.125, 0.375, 2.675, 1.005, 8.125, 8.615, 8.625, 99.995, 0.05, 0.25, 1e6 + 0.005, 3e-9, -0.04, -2.25, -2.35]
    values += [rng.gauss(0, 50) for _ in range(500)] + [round(rng.uniform(0, 400), 3) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed("v", digits).alias("plain"), fixed("v", digits, True).alias("signed"))
    for r in df.collect():
        assert r["plain"] == f"{r['v']:.{digits}f}", r
        assert r["signed"] == f"{r['v']:+.{digits}f}", r
