"""DuckDB SQL for every query: the same questions, written independently as plain joins and aggregates."""

from __future__ import annotations

from curdline.fixtures import HEADERS_SQL, RAW_ROWS_SQL, RECORDS_SQL
from curdline.schema import LAYOUTS, METRICS, NEXT_STEP, RECURRING_TEXT, REQUIRED_COLUMNS, RULES, SEED_NOTE

K = "facility, dcs, file_year, file_month"
P = "facility, file_year, file_month"
SFX = ["mean", "std", "median", "q1", "q3", "p90", "p10", "min", "max"]
BSFX = SFX[:7]


def _six(term: str) -> str:
    """Six digits by the same arithmetic in both engines (their round functions differ on ties)."""
    return f"floor(({term}) * 1000000 + 0.5) / 1000000"


def _r6(names: list[str]) -> str:
    return ", ".join(f"{_six(n)} AS {n}" for n in names)


def _mode(source: str, keys: str, value: str, out: str, where: str = "TRUE") -> str:
    """Most frequent value per key, the smallest on ties."""
    return f"""SELECT {keys}, {value} AS {out} FROM (
      SELECT {keys}, {value}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {value}) AS rn
      FROM {source} WHERE {where} GROUP BY {keys}, {value}) WHERE rn = 1"""


def _summary(m: str, snap: bool = True) -> str:
    terms = {
        "mean": f"avg({m})", "std": f"coalesce(stddev_samp({m}), 0)", "median": f"median({m})",
        "q1": f"quantile_cont({m}, 0.25)", "q3": f"quantile_cont({m}, 0.75)", "p90": f"quantile_cont({m}, 0.9)",
        "p10": f"quantile_cont({m}, 0.1)", "min": f"min({m})", "max": f"max({m})",
    }
    return ", ".join(f"round({t}, 9) AS {m}_{s}" if snap else f"{t} AS {m}_{s}" for s, t in terms.items())


R = f"r AS ({RECORDS_SQL})"

ST = f"""nm AS ({_mode('r', K, 'society_name', 'society_name')}),
p90 AS (SELECT {K}, quantile_cont(snf_pct, 0.9) AS lim FROM r GROUP BY ALL),
spike AS (SELECT {K}, count(*) FILTER (WHERE snf_pct > lim) AS high_snf_spike_count
          FROM r JOIN p90 USING ({K}) GROUP BY ALL),
agg AS (SELECT {K}, min(season) AS season, count(*) AS record_count,
          count(*) FILTER (WHERE shift = 'M') AS morning_count,
          count(*) FILTER (WHERE shift = 'E') AS evening_count,
          count(*) FILTER (WHERE qty < 10) AS low_qty_count, {', '.join(_summary(m) for m in METRICS)}
        FROM r GROUP BY ALL),
st AS (SELECT agg.*, society_name, high_snf_spike_count, file_year*100 + file_month AS ym
       FROM agg JOIN nm USING ({K}) JOIN spike USING ({K}))"""

_G = "facility, dcs, bs, tym"


def _baseline_ctes() -> str:
    means = ", ".join(
        f"sum(record_count*{m}_mean)/sum(record_count) FILTER ({m}_mean IS NOT NULL) AS {m}_wm, median({m}_median) AS {m}_median, "
        f"median({m}_q1) AS {m}_q1, median({m}_q3) AS {m}_q3, avg({m}_p90) AS {m}_p90, avg({m}_p10) AS {m}_p10"
        for m in METRICS
    )
    spread = ", ".join(
        f"CASE WHEN sum(record_count) FILTER ({m}_mean IS NOT NULL) <= 1 THEN 0 ELSE sqrt(sum((record_count-1)*coalesce({m}_std,0)*coalesce({m}_std,0)"
        f" + record_count*({m}_mean-{m}_wm)*({m}_mean-{m}_wm))"
        f" / (sum(record_count) FILTER ({m}_mean IS NOT NULL) - 1)) END AS {m}_ps"
        for m in METRICS
    )
    band = "snf_pct_mean >= snf_pct_q1 AND snf_pct_mean <= snf_pct_q3"
    out = []
    for m in METRICS:
        mean, std = f"round({m}_wm, 9)", f"round({m}_ps, 9)"
        if m == "snf_pct":
            trim = f"{std} > 0.5 AND k >= 2"
            mean, std = f"CASE WHEN {trim} THEN round(twm, 9) ELSE {mean} END", f"CASE WHEN {trim} THEN round(tps, 9) ELSE {std} END"
        out.append(f"{mean} AS {m}_mean, {std} AS {m}_std, " + ", ".join(
            f"round(g1.{m}_{s}, 9) AS {m}_{s}" for s in ["median", "q1", "q3", "p90", "p10"]))
    return f"""tg AS (SELECT DISTINCT ym AS tym FROM st),
ps AS (SELECT st.*, tym, 'all' AS bs FROM st JOIN tg ON ym < tym
       UNION ALL SELECT st.*, tym, season AS bs FROM st JOIN tg ON ym < tym),
bn AS ({_mode('ps', _G, 'society_name', 'society_name')}),
g1 AS (SELECT {_G}, count(*) AS months, sum(record_count) AS n,
         count(*) FILTER (WHERE season = 'summer') AS sm, count(*) FILTER (WHERE season = 'winter') AS wm,
         count(*) FILTER (WHERE {band}) AS k, {means} FROM ps GROUP BY ALL),
g2 AS (SELECT {_G}, {spread} FROM ps JOIN (SELECT {_G}, {', '.join(f'{m}_wm' for m in METRICS)} FROM g1) USING ({_G}) GROUP BY ALL),
t1 AS (SELECT {_G}, sum(record_count*snf_pct_mean)/sum(record_count) AS twm FROM ps WHERE {band} GROUP BY ALL),
t2 AS (SELECT {_G}, min(twm) AS twm, CASE WHEN sum(record_count) <= 1 THEN 0 ELSE sqrt(sum((record_count-1)*snf_pct_std*snf_pct_std
         + record_count*(snf_pct_mean-twm)*(snf_pct_mean-twm)) / (sum(record_count)-1)) END AS tps
       FROM ps JOIN t1 USING ({_G}) WHERE {band} GROUP BY ALL),
al AS (SELECT facility, dcs, tym, months AS prior FROM g1 WHERE bs = 'all'),
bq AS (SELECT g1.facility, g1.dcs, bn.society_name, g1.bs AS season, CAST(n AS BIGINT) AS record_count, al.prior AS prior_month_count,
         CASE WHEN g1.bs <> 'all' THEN months WHEN g1.tym % 100 BETWEEN 4 AND 9 THEN sm ELSE wm END AS same_season_prior_month_count,
         CAST(g1.tym // 100 AS INT) AS file_year, CAST(g1.tym % 100 AS INT) AS file_month, k, {', '.join(out)}
       FROM g1 JOIN g2 USING ({_G}) JOIN bn USING ({_G}) LEFT JOIN t2 USING ({_G})
       JOIN al ON al.facility = g1.facility AND al.dcs = g1.dcs AND al.tym = g1.tym),
bl AS (SELECT *, CASE WHEN prior_month_count >= 3 AND (season = 'all' OR same_season_prior_month_count >= 2)
         THEN 1 ELSE 0 END AS eligible FROM bq)"""


BL = _baseline_ctes()


def _z(value: str, m: str) -> str:
    s = f"coalesce(s.{m}_std, a.{m}_std)"
    mean = f"coalesce(s.{m}_mean, a.{m}_mean)"
    return f"CASE WHEN {s} = 0 THEN 0 ELSE ({value} - {mean}) / {s} END"


_Z = {"z_fat": "fat_pct", "z_snf": "snf_pct", "z_clr": "clr", "z_qty": "qty"}
_B = {"b_fat": "fat_pct", "b_snf": "snf_pct", "b_clr": "clr", "b_qty": "qty"}

SC = f"""z AS (SELECT r.*, CASE WHEN s.facility IS NULL THEN 1 ELSE 0 END AS low_seasonal_data,
    coalesce(s.record_count, a.record_count) AS baseline_records,
    {', '.join(f'{_z("r." + m, m)} AS {z}' for z, m in _Z.items())},
    {', '.join(f'coalesce(s.{m}_mean, a.{m}_mean) AS {b}' for b, m in _B.items())}
  FROM r LEFT JOIN (SELECT * FROM bl WHERE season <> 'all' AND eligible = 1 AND record_count >= 15) s
           ON s.facility = r.facility AND s.dcs = r.dcs AND s.season = r.season
              AND s.file_year = r.file_year AND s.file_month = r.file_month
         LEFT JOIN (SELECT * FROM bl WHERE season = 'all' AND eligible = 1 AND record_count >= 30) a
           ON a.facility = r.facility AND a.dcs = r.dcs AND a.file_year = r.file_year AND a.file_month = r.file_month
  WHERE s.facility IS NOT NULL OR a.facility IS NOT NULL),
sc AS (SELECT *, CASE WHEN z_snf < -2.0 AND snf_pct < 8.0 THEN 1 ELSE 0 END AS R1_snf_drop,
    CASE WHEN z_snf > 2.0 AND snf_pct > 9.2 THEN 1 ELSE 0 END AS R2_snf_spike,
    CASE WHEN z_fat < -2.5 AND fat_pct < b_fat - 2.0 THEN 1 ELSE 0 END AS R3_fat_drop,
    CASE WHEN z_snf > 1.5 AND z_fat < -0.5 AND snf_pct > 9.0 THEN 1 ELSE 0 END AS R4_ratio_break,
    CASE WHEN z_clr > 2.0 AND clr >= 29 THEN 1 ELSE 0 END AS R5_clr_spike,
    CASE WHEN z_qty > 2.0 AND (z_fat < -1.5 OR z_snf < -1.5) THEN 1 ELSE 0 END AS R6_dilution,
    CASE WHEN z_clr < -2.0 AND clr < 25 THEN 1 ELSE 0 END AS R7_clr_drop,
    0 AS R8_repeated_spike,
    CASE WHEN baseline_records < 30 THEN 1 ELSE 0 END AS thin_baseline,
    CASE WHEN abs(z_snf) > 3.5 OR abs(z_fat) > 3.5 OR abs(z_clr) > 3.5 THEN 1 ELSE 0 END AS extreme_z FROM z)"""

_RC = list(RULES.values())[:7]

FL = f"""th AS (SELECT * REPLACE ({', '.join(f'CASE WHEN thin_baseline = 1 AND extreme_z = 0 THEN 0 ELSE {c} END AS {c}' for c in _RC)}) FROM sc),
fi AS (SELECT * FROM th WHERE {' + '.join(_RC)} > 0),
dg AS (SELECT *, CASE WHEN R6_dilution = 1 THEN 'S6' WHEN R1_snf_drop = 1 AND R7_clr_drop = 1 THEN 'S1_7'
      WHEN R2_snf_spike = 1 AND R5_clr_spike = 1 THEN 'S2_5' WHEN R7_clr_drop = 1 THEN 'S7' WHEN R5_clr_spike = 1 THEN 'S5'
      WHEN R3_fat_drop = 1 THEN 'S3' WHEN R1_snf_drop = 1 THEN 'S1' WHEN R2_snf_spike = 1 THEN 'S2' ELSE 'S4' END AS "case",
    CASE WHEN z_snf < -1 OR z_fat < -1 OR z_clr < -1 THEN 'down' WHEN z_snf > 1 OR z_clr > 1 THEN 'up' ELSE 'mixed' END AS direction FROM fi),
cat("case", diagnosis, confidence_base) AS (VALUES ('S6', 'VOLUME_COMPOSITION_SHIFT', 'RESAMPLE'),
    ('S1_7', 'LOW_DENSITY_COMPOSITION_SCREEN', 'RESAMPLE'), ('S2_5', 'HIGH_DENSITY_COMPOSITION_SCREEN', 'RESAMPLE'),
    ('S7', 'LOW_DENSITY_SCREEN', 'REVIEW'), ('S5', 'HIGH_DENSITY_SCREEN', 'REVIEW'), ('S3', 'LOW_FAT_SCREEN', 'REVIEW'),
    ('S1', 'LOW_SOLIDS_SCREEN', 'REVIEW'), ('S2', 'HIGH_SOLIDS_SCREEN', 'REVIEW'),
    ('S4', 'COMPOSITION_RELATIONSHIP_SCREEN', 'REVIEW')),
ac AS (SELECT facility, file_year, file_month, date, shift, count(DISTINCT dcs) AS total_active FROM r GROUP BY ALL),
nd AS (SELECT facility, file_year, file_month, date, shift, direction, count(DISTINCT dcs) AS num_dir FROM dg GROUP BY ALL),
ev AS (SELECT nd.*, total_active, num_dir / total_active * 100 AS pct_flagged,
         CASE WHEN num_dir / total_active * 100 > 30 THEN 1 ELSE 0 END AS seasonal_likely
       FROM nd JOIN ac USING (facility, file_year, file_month, date, shift)),
cf AS (SELECT dg.*, diagnosis, confidence_base,
         CASE WHEN qty < 10 AND confidence_base = 'RESAMPLE' THEN 'REVIEW' WHEN qty < 10 THEN 'MONITOR' ELSE confidence_base END AS c1
       FROM dg JOIN cat USING ("case")),
fl AS (SELECT cf.*, num_dir, total_active, pct_flagged, seasonal_likely,
         CASE WHEN low_seasonal_data = 1 AND c1 = 'RESAMPLE' THEN 'REVIEW' ELSE c1 END AS confidence,
         concat_ws('; ', CASE WHEN qty < 10 THEN 'screening priority reduced for QTY < 10L' END,
           CASE WHEN low_seasonal_data = 1 AND c1 = 'RESAMPLE' THEN 'screening priority capped because same-season history is thin' END) AS confidence_note
       FROM cf JOIN ev USING (facility, file_year, file_month, date, shift, direction)),
rep AS (SELECT * FROM fl WHERE seasonal_likely = 0)"""

_FULL = f"WITH {R},\n{ST},\n{BL},\n{SC},\n{FL}"
_SCORED = f"WITH {R},\n{ST},\n{BL},\n{SC}"
_ID = "facility, serial_no, dcs, date, shift, file_year, file_month"
_S = "facility, dcs, society_name"
_STATS = [f"{m}_{s}" for m in METRICS for s in SFX]
_BSTATS = [f"{m}_{s}" for m in METRICS for s in BSFX]

_TOTALS = f"""tr AS (SELECT {P}, count(*) AS records_processed, count(DISTINCT dcs) AS distinct_dcs FROM r GROUP BY ALL),
tf AS (SELECT {P}, count(*) AS initial_flags, count(*) FILTER (WHERE seasonal_likely = 1) AS seasonal_suppressed,
         count(*) FILTER (WHERE seasonal_likely = 0) AS final_flags,
         count(*) FILTER (WHERE seasonal_likely = 0 AND confidence = 'RESAMPLE') AS resample FROM fl GROUP BY ALL),
tot AS (SELECT tr.*, coalesce(initial_flags, 0) AS initial_flags, coalesce(seasonal_suppressed, 0) AS seasonal_suppressed,
          coalesce(final_flags, 0) AS final_flags, coalesce(resample, 0) AS resample,
          CASE WHEN coalesce(final_flags, 0) > 0 THEN 'detection' ELSE 'seed_only' END AS mode
        FROM tr LEFT JOIN tf USING ({P}))"""

_SEVERITY = f"""sv0 AS (SELECT {_S}, file_year, file_month, count(*) AS flags FROM rep GROUP BY ALL),
svm AS ({_mode('rep', f'{_S}, file_year, file_month', 'diagnosis', 'primary_diagnosis')}),
sv AS (SELECT sv0.*, CASE WHEN flags >= 30 THEN 'VERY_FREQUENT' WHEN flags >= 15 THEN 'FREQUENT' WHEN flags >= 8 THEN 'RECURRING'
         ELSE 'ISOLATED' END AS severity, primary_diagnosis FROM sv0 JOIN svm USING ({_S}, file_year, file_month))"""

_TOP5 = f"""t5 AS (SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY flags DESC, dcs, society_name) AS rank FROM sv)"""

_CASES = f"""cs AS (SELECT DISTINCT substr(sha256(concat_ws('|', facility, CAST(serial_no AS VARCHAR), CAST(CAST(dcs AS BIGINT) AS VARCHAR),
      strftime(date, '%d-%m-%Y'), shift, CAST(file_year AS VARCHAR), CAST(file_month AS VARCHAR), diagnosis)), 1, 20) AS case_id,
    facility, dcs, society_name, file_year, file_month, strftime(date, '%d-%m-%Y') AS screening_date, shift,
    diagnosis AS screening_category, confidence AS priority FROM rep),
rc AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE priority WHEN 'RESAMPLE' THEN 1
         WHEN 'REVIEW' THEN 2 WHEN 'MONITOR' THEN 3 ELSE 4 END, society_name) AS rn FROM cs) WHERE rn = 1)"""

_PRIO = "CASE priority WHEN 'RESAMPLE' THEN 1 WHEN 'REVIEW' THEN 2 WHEN 'MONITOR' THEN 3 ELSE 4 END"
_EXPLAIN = " || ".join(
    [f"printf('{label} %.{d}f{unit} (base %.{d}f, z=%+.1f){end}', {v}, {b}, {z})" for label, d, unit, v, b, z, end in [
        ("SNF", 2, "%%", "snf_pct", "b_snf", "z_snf", "; "), ("Fat", 2, "%%", "fat_pct", "b_fat", "z_fat", "; "),
        ("CLR", 1, "", "clr", "b_clr", "z_clr", "; "), ("QTY", 1, "", "qty", "b_qty", "z_qty", ". ")]]
    + ["'Screening category: ' || diagnosis || '. Confirmatory testing is required.'",
       "CASE WHEN confidence_note <> '' THEN ' Note: ' || confidence_note || '.' ELSE '' END"]
)


def _raw_ctes() -> str:
    def num(c: str) -> str:
        return (f"CASE WHEN regexp_full_match(trim({c}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
                f"THEN TRY_CAST(trim({c}) AS DOUBLE) END AS n_{c}")

    nums = ["qty", "fat_pct", "snf_pct", "clr", "dcs", "kg_fat", "kg_snf", "rate", "amount"]
    texts = ["vehicle", "date", "shift", "dcs", "society_name", "qty", "fat_pct", "snf_pct", "clr", "kg_fat", "kg_snf", "rate", "amount"]
    filled = " OR ".join(f"coalesce(trim({c}), '') <> ''" for c in texts)
    bad = [("coalesce(trim(serial_no), '') = ''", "missing_serial_no"), ("d IS NULL", "missing_or_invalid_date")]
    bad += [(f"n_{c} IS NULL", f"missing_or_invalid_{c}") for c in ["dcs", "fat_pct", "snf_pct", "clr", "qty"]]
    bad += [("sh IS NULL", "missing_or_invalid_shift"), ("coalesce(trim(society_name), '') = ''", "missing_society_name")]
    reasons = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in bad)
    return f"""raw AS ({RAW_ROWS_SQL}),
dr AS (SELECT *, {', '.join(num(c) for c in nums)},
    CAST(CASE WHEN regexp_matches(trim(date), '^[0-9]{{4}}-') THEN try_strptime(trim(date), '%Y-%m-%d')
         ELSE try_strptime(replace(trim(date), '/', '-'), '%d-%m-%Y') END AS DATE) AS d,
    CASE WHEN upper(trim(shift)) IN ('M', 'MORNING') THEN 'M' WHEN upper(trim(shift)) IN ('E', 'EVENING') THEN 'E' END AS sh
  FROM raw WHERE (serial_no IS NOT NULL OR {filled})
    AND NOT (serial_no IS NULL AND coalesce(upper(trim(society_name)), '') IN ('TOTAL', 'GRAND TOTAL', 'SUBTOTAL'))),
va AS (SELECT *, concat_ws('; ', {reasons}) AS rejection_reason FROM dr)"""


_RAW = f"WITH {_raw_ctes()}"


def _layout_case() -> str:
    out = "CASE"
    for name, columns in LAYOUTS.items():
        need = ", ".join(f"'{s}'" for s, d in columns.items() if d in REQUIRED_COLUMNS)
        out += f" WHEN list_has_all(h, [{need}]) THEN '{name}'"
    return out + " END"


_MONTHS = ("CASE lower(regexp_extract(source_file, 'month of +([A-Za-z]+)', 1)) WHEN 'january' THEN 1 WHEN 'feb' THEN 2 WHEN 'march' THEN 3 "
           "WHEN 'april' THEN 4 WHEN 'may' THEN 5 WHEN 'jun' THEN 6 WHEN 'july' THEN 7 WHEN 'aug' THEN 8 WHEN 'sept' THEN 9 "
           "WHEN 'october' THEN 10 WHEN 'nov' THEN 11 WHEN 'december' THEN 12 END")


def _raw_baselines() -> str:
    g = "facility, dcs, season"
    cols = ", ".join(_summary(m, snap=False) for m in METRICS)
    out = []
    for m in METRICS:
        for s in SFX:
            term = f"round(b.{m}_{s}, 9)"
            if m == "snf_pct" and s in ("mean", "std"):
                term = f"CASE WHEN round(b.snf_pct_std, 9) > 0.5 AND tn >= 5 THEN round(t{s}, 9) ELSE {term} END"
            out.append(f"{_six(term)} AS {m}_{s}")
    return f"""WITH {R},
x AS (SELECT * FROM r UNION ALL SELECT * REPLACE ('all' AS season) FROM r),
b AS (SELECT {g}, count(*) AS record_count, {cols} FROM x GROUP BY ALL HAVING count(*) >= 10),
nm AS ({_mode('x', g, 'society_name', 'society_name')}),
t AS (SELECT {g}, count(*) AS tn, avg(snf_pct) AS tmean, coalesce(stddev_samp(snf_pct), 0) AS tstd
      FROM x JOIN (SELECT {g}, snf_pct_q1 AS lo, snf_pct_q3 AS hi FROM b) USING ({g})
      WHERE snf_pct >= lo AND snf_pct <= hi GROUP BY ALL)
SELECT {g}, society_name, record_count, 1 AS eligible, {', '.join(out)}
FROM b JOIN nm USING ({g}) LEFT JOIN t USING ({g})"""


def oracle_sql() -> dict[str, str]:
    z6 = _r6(["z_fat", "z_snf", "z_clr", "z_qty"])
    b6 = _r6(["b_fat", "b_snf", "b_clr", "b_qty"])
    rules = ", ".join(RULES.values())
    fired = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} = 1 THEN '{r}' END" for r, c in RULES.items()) + ")"
    detail_order = "date, shift, serial_no, diagnosis, qty, fat_pct, snf_pct, clr"
    q: dict[str, str] = {}
    q["month_stats"] = (f"WITH {R},\n{ST}\nSELECT {K}, season, society_name, record_count, morning_count, evening_count, "
                        f"low_qty_count, {_r6(_STATS)} FROM st")
    q["snf_spike_count"] = f"WITH {R},\n{ST}\nSELECT {K}, high_snf_spike_count FROM st"
    base = f"WITH {R},\n{ST},\n{BL}"
    q["baseline_all_periods"] = (f"{base}\nSELECT {K}, season, society_name, record_count, prior_month_count, "
                                 f"same_season_prior_month_count, eligible, {_r6(_BSTATS)} FROM bl")
    q["baseline_snf_trim"] = (f"{base}\nSELECT {K}, season, {_r6(['snf_pct_mean', 'snf_pct_std'])} FROM bl")
    gaps = f"""WITH r0 AS ({RECORDS_SQL}),
r AS (SELECT * REPLACE (CASE WHEN (file_month + CAST(dcs AS BIGINT)) % 3 <> 0 THEN clr END AS clr) FROM r0),
{ST},\n{BL}"""
    q["baseline_months_without_values"] = (f"{gaps}\nSELECT {K}, season, record_count, {_r6(['clr_mean', 'clr_std', 'clr_median', 'clr_p90'])} FROM bl")
    q["replaced_periods"] = (f"WITH {R},\n{ST}\nSELECT {K}, season, society_name, record_count FROM st "
                             f"WHERE NOT (facility = 'FacilityA' AND file_year % 2 = 0 AND dcs % 3 = 0)")
    q["committed_versions"] = f"""WITH {R},\n{ST},
c AS (SELECT unnest(['first', 'second', 'newest']) AS version, {P}, dcs % 5 = 0 AS changed, record_count FROM st)
SELECT version, {P}, count(*) AS societies,
  CAST(sum(CASE WHEN changed AND version <> 'first' THEN -record_count ELSE record_count END) AS BIGINT) AS record_count,
  count(*) FILTER (changed AND version <> 'first') AS replaced FROM c GROUP BY ALL"""
    q["baseline_snapshot"] = (f"{base}\nSELECT {K}, season, society_name, record_count, prior_month_count, "
                              f"same_season_prior_month_count, eligible FROM bl")
    q["eligible_baseline_rows"] = (f"{base}\nSELECT file_year, file_month, CAST(sum(eligible) AS BIGINT) AS "
                                   f"eligible_baseline_rows FROM bl GROUP BY ALL")
    q["raw_baselines"] = _raw_baselines()
    q["scored_records"] = f"{_SCORED}\nSELECT {_ID}, baseline_records, low_seasonal_data, {z6}, {b6} FROM sc"
    q["rule_flags"] = f"{_SCORED}\nSELECT {_ID}, {rules} FROM sc WHERE {' + '.join(_RC)} > 0"
    q["thin_suppression"] = (f"{_FULL}\nSELECT {P}, thin_baseline, extreme_z, count(*) AS records, "
                             f"CAST(sum(CASE WHEN {' + '.join(_RC)} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM th GROUP BY ALL")
    q["diagnosis"] = f"{_FULL}\nSELECT {_ID}, diagnosis, confidence_base AS confidence, \"case\" FROM fl"
    q["priority_adjust"] = f"{_FULL}\nSELECT {_ID}, diagnosis, confidence_base, confidence, confidence_note FROM fl"
    q["rules_fired"] = f"{_FULL}\nSELECT {_ID}, {fired} AS rules_fired FROM fl"
    q["explanation"] = f"{_FULL}\nSELECT {_ID}, {_EXPLAIN} AS explanation FROM fl"
    q["flags"] = (f"{_FULL}\nSELECT {_ID}, society_name, CAST(NULL AS VARCHAR) AS vehicle, qty, fat_pct, snf_pct, clr, {z6}, {rules}, "
                  f"low_seasonal_data, {b6}, season, direction, num_dir, total_active, {_six('pct_flagged')} AS pct_flagged, "
                  f"seasonal_likely, diagnosis, confidence, \"case\", {_EXPLAIN} AS explanation, confidence_base, confidence_note FROM fl")
    q["exported_flags"] = (f"{_FULL}\nSELECT {_S}, date, shift, CAST(NULL AS VARCHAR) AS vehicle, qty, fat_pct, snf_pct, clr, {z6}, "
                           f"{fired} AS rules_fired, diagnosis, confidence, {_EXPLAIN} AS explanation, "
                           f"seasonal_likely = 1 AS seasonal_suppressed, file_month, file_year FROM fl")
    q["active_societies"] = (f"WITH {R}\nSELECT facility, file_year, file_month, date, shift, count(DISTINCT dcs) AS total_active "
                             f"FROM r GROUP BY ALL")
    q["shared_event"] = (f"{_FULL}\nSELECT facility, file_year, file_month, date, shift, direction, num_dir, total_active, "
                         f"{_six('pct_flagged')} AS pct_flagged, seasonal_likely FROM ev")
    q["report_records"] = f"{_FULL}\nSELECT {_ID}, society_name, diagnosis, confidence FROM rep"
    q["run_mode"] = f"{_FULL},\n{_TOTALS}\nSELECT {P}, mode FROM tot"
    q["daily_summary"] = f"""{_FULL},
nf AS (SELECT facility, file_year, file_month, date, shift, count(DISTINCT dcs) AS nf FROM fl GROUP BY ALL)
SELECT facility, file_year, file_month, date, shift, total_active, coalesce(nf, 0) AS num_flagged,
  {_six('coalesce(nf, 0) / total_active * 100')} AS pct_flagged,
  CASE WHEN coalesce(nf, 0) / total_active * 100 > 30 THEN 1 ELSE 0 END AS seasonal_event
FROM ac LEFT JOIN nf USING (facility, file_year, file_month, date, shift)"""
    sev = f"SELECT {_S}, file_year, file_month, flags, severity, primary_diagnosis FROM sv"
    q["severity"] = f"""{_FULL},\n{_SEVERITY},
lp AS (SELECT min(ym) AS lo FROM (SELECT DISTINCT file_year*100 + file_month AS ym FROM rep ORDER BY ym DESC LIMIT 6))
{sev} WHERE file_year*100 + file_month >= (SELECT lo FROM lp)"""
    q["severity_by_period"] = f"{_FULL},\n{_SEVERITY}\n{sev}"
    q["month_summary"] = f"""{_FULL},\n{_TOTALS},\n{_SEVERITY},\n{_TOP5},
tm AS ({_mode('rep', P, 'diagnosis', 'top_diagnosis')}),
ls AS (SELECT {P}, string_agg(CAST(CAST(dcs AS BIGINT) AS VARCHAR) || ':' || society_name || ':' || flags || ':' || primary_diagnosis, '|' ORDER BY rank) AS tops
       FROM t5 WHERE rank <= 5 GROUP BY ALL)
SELECT {P}, records_processed, distinct_dcs AS societies_active, initial_flags, seasonal_suppressed, final_flags,
  resample AS high_confidence_flags, resample AS priority_resample_flags, coalesce(top_diagnosis, '') AS top_diagnosis,
  coalesce(top_diagnosis, '') AS top_screening_category, coalesce(tops, '') AS top_flagged_societies,
  CASE WHEN mode = 'detection' THEN '' ELSE '{SEED_NOTE}' END AS notes, mode
FROM tot LEFT JOIN tm USING ({P}) LEFT JOIN ls USING ({P})"""
    q["top_societies"] = f"{_FULL},\n{_SEVERITY},\n{_TOP5}\nSELECT {P}, rank, dcs, society_name, flags, primary_diagnosis FROM t5 WHERE rank <= 5"
    q["audit_metrics"] = f"""{_FULL},\n{_TOTALS}
SELECT {P}, metric, value, mode FROM (
  SELECT {P}, mode, unnest(['records_processed', 'societies_active', 'initial_flags', 'seasonal_suppressed', 'final_flags']) AS metric,
    unnest([records_processed, distinct_dcs, initial_flags, seasonal_suppressed, final_flags]) AS value FROM tot)"""
    q["audit_appended"] = q["audit_metrics"]
    q["run_summary"] = (f"{_FULL},\n{_TOTALS}\nSELECT {P}, mode, records_processed, initial_flags, seasonal_suppressed, final_flags FROM tot")
    q["batch_summary"] = f"""{_FULL},
br AS (SELECT file_year, file_month, count(*) AS records_processed, count(DISTINCT dcs) AS societies_active,
         count(DISTINCT facility) AS facility_count FROM r GROUP BY ALL),
bf AS (SELECT file_year, file_month, count(*) FILTER (WHERE seasonal_likely = 0) AS n FROM fl GROUP BY ALL)
SELECT br.*, CASE WHEN coalesce(n, 0) > 0 THEN 'detection' ELSE 'seed_only' END AS mode FROM br LEFT JOIN bf USING (file_year, file_month)"""
    q["processing_metrics"] = f"{_FULL},\n{_TOTALS}\nSELECT {P}, records_processed, distinct_dcs AS societies_active, CAST(1 AS BIGINT) AS facility_count, mode FROM tot"
    q["history_count"] = f"""WITH {R}, n AS (SELECT {P}, count(DISTINCT dcs) AS c FROM r GROUP BY ALL)
SELECT {P}, CAST(coalesce(sum(c) OVER (ORDER BY file_year, file_month, facility ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
  AS historical_month_stats_count FROM n"""
    q["history_count_late"] = q["history_count"].replace("ORDER BY file_year", "ORDER BY file_month = 3, file_year")
    two = ", ".join(f"round_even(round(avg({m}), 9) * 100, 0) / 100 AS {a}" for m, a in [("fat_pct", "avg_fat"), ("snf_pct", "avg_snf"), ("clr", "avg_clr")])
    q["facility_overview"] = f"WITH {R}\nSELECT {P}, count(*) AS records, count(DISTINCT dcs) AS societies, {two} FROM r GROUP BY ALL"
    q["category_distribution"] = f"{_FULL}\nSELECT {P}, diagnosis, count(*) AS count FROM rep GROUP BY ALL"
    q["priority_distribution"] = f"{_FULL}\nSELECT {P}, confidence, count(*) AS count FROM rep GROUP BY ALL"
    q["recurring"] = f"""{_FULL}
SELECT {P}, dcs, society_name, diagnosis, count(*) AS screening_signal_count, min(date) AS first_signal_date, max(date) AS last_signal_date,
  CASE WHEN bool_or(confidence = 'RESAMPLE') THEN 'RESAMPLE' WHEN bool_or(confidence = 'REVIEW') THEN 'REVIEW' ELSE 'MONITOR' END AS highest_priority,
  'RECURRING_SCREENING_PATTERN' AS indicator, '{RECURRING_TEXT}' AS interpretation
FROM rep GROUP BY {P}, dcs, society_name, diagnosis HAVING count(*) >= 2"""
    fz = " + ".join(f"abs(CASE WHEN {k}_dev = 0 THEN 0 ELSE ({m}_mean - {k}_avg) / {k}_dev END)" for k, m in [("fat", "fat_pct"), ("snf", "snf_pct"), ("clr", "clr")])
    fa = ", ".join(f"round(avg({m}_mean), 9) AS {k}_avg, round(coalesce(stddev_samp({m}_mean), 0), 9) AS {k}_dev" for k, m in [("fat", "fat_pct"), ("snf", "snf_pct"), ("clr", "clr")])
    q["watchlist"] = f"""WITH {R},\n{ST},
fs AS (SELECT {P}, {fa} FROM st GROUP BY ALL),
ws AS (SELECT {P}, dcs, society_name, record_count, fat_pct_mean AS fat_mean, snf_pct_mean AS snf_mean, clr_mean,
         CAST(printf('%.2f', {fz}) AS DOUBLE) AS deviation_score FROM st JOIN fs USING ({P})),
wr AS (SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY deviation_score DESC, facility, dcs, society_name) AS rank FROM ws)
SELECT {P}, rank, dcs, society_name, record_count, {_r6(['fat_mean', 'snf_mean', 'clr_mean'])}, deviation_score FROM wr WHERE rank <= 15"""
    lists = {
        "current_month_stats": f"SELECT {P}, dcs FROM st", "historical_baselines": f"SELECT {P}, dcs FROM bl JOIN (SELECT DISTINCT {P} FROM r) USING ({P})",
        "anomaly_records": f"SELECT {P}, dcs FROM fl", "report_records": f"SELECT {P}, dcs FROM rep", "daily_summary": f"SELECT {P}, 0 AS dcs FROM ac",
        "severity": f"SELECT {P}, dcs FROM sv",
        "recurring_signal_indicators": f"SELECT {P}, dcs FROM rep GROUP BY {P}, dcs, society_name, diagnosis HAVING count(*) >= 2",
        "detail_rows": f"""SELECT {P}, dcs FROM rep WHERE NOT (diagnosis = 'UNCLASSIFIED_SCREENING_SIGNAL'
          AND confidence = 'MONITOR' AND abs(z_snf) <= 1.5 AND abs(z_fat) <= 1.5 AND abs(z_clr) <= 1.5)""",
    }
    items = ",\n".join([f"li_{n} AS ({sql})" for n, sql in lists.items()]) + ",\nli AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS list, {P}, count(*) AS items, CAST(sum(dcs) AS BIGINT) AS dcs_total FROM li_{n} GROUP BY ALL" for n in lists) + ")"
    q["bundle_items"] = f"{_FULL},\n{_SEVERITY},\n{items}\nSELECT {P}, list, items, dcs_total FROM li"
    sizes = ", ".join(f"CAST(coalesce(sum(items) FILTER (WHERE list = '{n}'), 0) AS BIGINT) AS {n}{'' if n == 'detail_rows' else '_rows'}" for n in lists)
    q["bundle"] = f"""{_FULL},\n{_SEVERITY},\n{_TOTALS},\n{items},
sz AS (SELECT {P}, {sizes} FROM li GROUP BY ALL),
hc AS (SELECT {P}, CAST(coalesce(sum(c) OVER (ORDER BY file_year, file_month, facility ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
  AS history_rows, least(c, 15) AS watchlist_rows FROM (SELECT {P}, count(*) AS c FROM st GROUP BY ALL)),
el AS (SELECT file_year, file_month, CAST(sum(eligible) AS BIGINT) AS eligible_baseline_rows FROM bl GROUP BY ALL)
SELECT {P}, mode, mode AS run_mode, records_processed, distinct_dcs AS societies_active, initial_flags, seasonal_suppressed, final_flags, history_rows,
  sz.* EXCLUDE (facility, file_year, file_month), coalesce(eligible_baseline_rows, 0) AS eligible_baseline_rows, watchlist_rows, final_flags AS categorized_flags,
  CAST(15 AS BIGINT) AS fields, CASE WHEN file_month BETWEEN 4 AND 9 THEN 'summer' ELSE 'winter' END AS season,
  CASE WHEN mode = 'detection' THEN 'Prioritized ' || final_flags || ' records for review for ' || printf('%s %d-%02d', facility, file_year, file_month) || '.'
    ELSE 'Calibration report for ' || printf('%s %d-%02d', facility, file_year, file_month) || '; history is not yet sufficient for record-level screening.' END AS summary_text
FROM tot JOIN sz USING ({P}) JOIN hc USING ({P}) LEFT JOIN el USING (file_year, file_month)"""
    watch = q["watchlist"].split(",\nfs AS", 1)[1].rsplit("\nSELECT", 1)[0]
    q["top_findings"] = f"""{_FULL},\n{_SEVERITY},\nfs AS{watch},
s8 AS (SELECT {P}, row_number() OVER (PARTITION BY {P} ORDER BY dcs, society_name) AS rank, facility AS finding_facility, dcs, society_name, severity AS finding FROM sv)
SELECT * FROM s8 WHERE rank <= 8 UNION ALL
SELECT {P}, rank, facility, dcs, society_name, 'WATCHLIST' FROM wr ANTI JOIN sv USING ({P}) WHERE rank <= 8"""
    q["top_signals"] = f"""{_FULL},
g AS (SELECT {P}, dcs, society_name, diagnosis, count(*) AS count FROM rep GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY count DESC, dcs, society_name, diagnosis) AS rank FROM g)
SELECT * FROM k WHERE rank <= 15"""
    q["category_share"] = f"""{_FULL},
g AS (SELECT {P}, diagnosis, count(*) AS count FROM rep GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY count DESC, diagnosis) AS rank,
        sum(count) OVER (PARTITION BY {P}) AS total FROM g)
SELECT {P}, rank, diagnosis, count, {_six('count / CAST(total AS DOUBLE) * 100')} AS pct_of_facility FROM k WHERE rank <= 5"""
    q["keyword_top"] = f"""{_FULL},
kw(keyword) AS (VALUES ('LOW_'), ('HIGH_'), ('VOLUME_'), ('RELATIONSHIP_')),
g AS (SELECT {P}, keyword, dcs, society_name, count(*) AS count FROM rep JOIN kw ON contains(diagnosis, keyword) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY {P}, keyword ORDER BY count DESC, dcs, society_name) AS rank FROM g)
SELECT * FROM k WHERE rank <= 5"""
    focus = f"""js AS (SELECT rep.*, severity FROM rep JOIN sv USING ({_S}, file_year, file_month)),
fo AS (SELECT * FROM (SELECT *, max(CASE WHEN severity IN ('VERY_FREQUENT', 'FREQUENT') THEN 1 ELSE 0 END) OVER (PARTITION BY {P}) AS hf FROM js)
       WHERE hf = 0 OR severity IN ('VERY_FREQUENT', 'FREQUENT'))"""
    q["detail_rows"] = (f"{_FULL}\nSELECT {_ID}, diagnosis, confidence FROM rep WHERE NOT (diagnosis = 'UNCLASSIFIED_SCREENING_SIGNAL' "
                        f"AND confidence = 'MONITOR' AND abs(z_snf) <= 1.5 AND abs(z_fat) <= 1.5 AND abs(z_clr) <= 1.5)")
    q["detail_focus"] = f"{_FULL},\n{_SEVERITY},\n{focus}\nSELECT {_ID}, diagnosis, severity FROM fo"
    q["detail_head"] = f"""{_FULL},\n{_SEVERITY},\n{focus},
dh AS (SELECT *, row_number() OVER (PARTITION BY {P}, dcs, society_name ORDER BY {detail_order}) AS row_rank,
         count(*) OVER (PARTITION BY {P}, dcs, society_name) AS total_flags,
         dense_rank() OVER (PARTITION BY {P} ORDER BY dcs, society_name) AS society_rank FROM fo)
SELECT {_ID}, society_name, diagnosis, severity, row_rank, society_rank, total_flags, greatest(total_flags - 10, 0) AS more_rows
FROM dh WHERE row_rank <= 10 AND society_rank <= 8"""
    case_cols = "case_id, facility, dcs, society_name, file_year, file_month, screening_date, shift, screening_category, priority"
    texts = f"'{NEXT_STEP}' AS recommended_next_step, CAST(NULL AS VARCHAR) AS disposition, CAST(NULL AS VARCHAR) AS confirmation_reference"
    q["review_cases"] = f"{_FULL},\n{_CASES}\nSELECT {case_cols}, 'OPEN' AS status, {texts} FROM rc"
    q["case_list"] = f"""{_FULL},\n{_CASES}
SELECT case_id, row_number() OVER (ORDER BY file_year DESC, file_month DESC, {_PRIO}, case_id) AS place FROM rc
ORDER BY file_year DESC, file_month DESC, {_PRIO}, case_id"""
    closing = "case_id < '4'"
    q["case_update"] = f"""{_FULL},\n{_CASES}
SELECT case_id, CASE WHEN {closing} THEN 'LAB_PENDING' ELSE 'OPEN' END AS status,
  CASE WHEN {closing} THEN 'resample ' || facility END AS disposition,
  CASE WHEN {closing} AND shift = 'M' THEN 'ref ' || case_id END AS confirmation_reference FROM rc"""
    q["case_merge"] = f"""{_FULL},\n{_CASES}
SELECT case_id, priority, CASE WHEN {closing} THEN 'DISMISSED' ELSE 'OPEN' END AS status FROM rc"""
    q["keyed_merge"] = f"""WITH {R}, m AS (SELECT {K}, count(*) AS n, max(qty) AS top FROM r GROUP BY ALL)
SELECT {K}, CASE WHEN file_month BETWEEN 4 AND 9 THEN n ELSE -n END AS n, {_six('top')} AS top,
  CASE WHEN file_month BETWEEN 4 AND 9 THEN 'new' ELSE 'old' END AS origin FROM m"""
    q["new_periods"] = f"""WITH {R}
SELECT {P}, count(*) AS records FROM r WHERE file_month NOT IN (2, 7) AND NOT (facility = 'FacilityB' AND file_year < 1998) GROUP BY ALL"""
    q["skipped_periods"] = f"""WITH {R}
SELECT DISTINCT {P}, printf('%s:%04d-%02d', facility, file_year, file_month) AS period FROM r
WHERE file_month IN (2, 7) OR (facility = 'FacilityB' AND file_year < 1998)"""
    q["file_identity"] = f"""WITH raw AS ({RAW_ROWS_SQL})
SELECT source_file, facility, CAST({_MONTHS} AS INT) AS file_month, file_year, count(*) AS rows FROM raw GROUP BY ALL"""
    head = f"WITH hd AS ({HEADERS_SQL}), hs AS (SELECT *, list_transform(string_split(header_text, '|'), lambda c: trim(c)) AS h FROM hd)"
    q["layout_detect"] = f"{head}\nSELECT {P}, {_layout_case()} AS schema_layout FROM hs"
    q["schema_fingerprint"] = f"{head}\nSELECT {P}, substr(sha256(array_to_string(h, chr(10))), 1, 16) AS schema_fingerprint FROM hs"
    named = "serial_no, vehicle, date, shift, dcs, society_name, qty, fat_pct, snf_pct, clr, kg_fat, kg_snf, rate, amount".split(", ")

    def scanned(kind: str, empty_is_null: bool = True) -> str:
        cells = ", ".join(f"nullif({c}, '') AS {c}" if empty_is_null else c for c in named)
        return f"""WITH raw AS ({RAW_ROWS_SQL})
SELECT replace(source_file, '.csv', '.{kind}') AS source_file, row_number() OVER (PARTITION BY source_file ORDER BY source_row, {", ".join(f"{c} NULLS FIRST" for c in named)}) + 1 AS source_row, {P},
  CASE WHEN facility = 'FacilityA' THEN 'layout_a' ELSE 'layout_b' END AS schema_layout, {cells} FROM raw"""

    q["scanned_reports"] = scanned("csv")
    q["parquet_reports"] = scanned("parquet", False)
    q["row_numbers"] = f"""WITH raw AS ({RAW_ROWS_SQL})
SELECT source_file, CAST(2 AS BIGINT) AS first_row, count(*) + 1 AS last_row, count(*) AS rows FROM raw GROUP BY ALL"""
    q["scanned_new_reports"] = f"""WITH raw AS ({RAW_ROWS_SQL})
SELECT source_file, CASE WHEN facility = 'FacilityA' THEN 'layout_a' ELSE 'layout_b' END AS schema_layout, count(*) AS rows FROM raw
WHERE file_month NOT IN (2, 7) AND NOT (facility = 'FacilityB' AND file_year < 1998) GROUP BY ALL"""
    q["strict_gate"] = f"""{_RAW},
g AS (SELECT source_file, count(*) FILTER (rejection_reason = '') AS accepted_rows, count(*) FILTER (rejection_reason <> '') AS rejected_rows FROM va GROUP BY ALL)
SELECT source_file, rejected_rows > 0 OR accepted_rows = 0 AS refused, accepted_rows, rejected_rows,
  CASE WHEN rejected_rows > 0 THEN 0 ELSE accepted_rows END AS loaded FROM g"""
    q["row_rejections"] = f"{_RAW}\nSELECT source_file, source_row, rejection_reason FROM va WHERE rejection_reason <> ''"
    q["accepted_records"] = f"""{_RAW}
SELECT source_file, source_row, facility, file_year, file_month, serial_no, trim(vehicle) AS vehicle, d AS date, sh AS shift, n_dcs AS dcs,
  trim(society_name) AS society_name, n_qty AS qty, n_fat_pct AS fat_pct, n_snf_pct AS snf_pct, n_clr AS clr, n_kg_fat AS kg_fat,
  n_kg_snf AS kg_snf, n_rate AS rate, n_amount AS amount, CASE WHEN file_month BETWEEN 4 AND 9 THEN 'summer' ELSE 'winter' END AS season
FROM va WHERE rejection_reason = ''"""
    q["rejection_counts"] = f"{_RAW}\nSELECT source_file, rejection_reason, count(*) AS rows FROM va WHERE rejection_reason <> '' GROUP BY ALL"
    q["validation_report"] = f"""{_RAW},
s AS (SELECT source_file, facility, file_year, file_month, count(*) AS rows_seen FROM raw GROUP BY ALL),
v AS (SELECT source_file, count(*) AS data_rows_seen, count(*) FILTER (WHERE rejection_reason = '') AS accepted_rows,
        count(*) FILTER (WHERE rejection_reason <> '') AS rejected_rows,
        count(*) FILTER (WHERE year(d) <> file_year OR month(d) <> file_month) AS rows_outside_period FROM va GROUP BY ALL)
SELECT s.*, data_rows_seen, accepted_rows, rejected_rows, rows_outside_period FROM s JOIN v USING (source_file)"""
    q["rejected_preview"] = f"""{_RAW},
k AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY source_row, serial_no, dcs) AS rn FROM va WHERE rejection_reason <> '')
SELECT source_file, source_row FROM k WHERE rn <= 20"""
    return q
