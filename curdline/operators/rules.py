"""Scoring against baselines and the rule set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curdline.functions.expressions import any_of, fixed, flag, with_missing, zscore
from curdline.operators.month_stats import clean_measures
from curdline.schema import ALL_YEAR, LIMITS, NOTE_LOW_QTY, NOTE_THIN_SEASON, RULES, SEASONS

_LOOKUP_VALUES = [f"{m}_{s}" for m in ["fat_pct", "snf_pct", "clr", "qty"] for s in ["mean", "std"]]


def baseline_lookup(baselines: DataFrame) -> DataFrame:
    """The one baseline that applies to each (society, period, season), if any.

    The fallback is resolved here, on the small side, so that records are joined only once. A seasonal row
    is used if it is eligible and has enough records, else the all-year row if that one is.
    """
    period = [c for c in ["file_year", "file_month"] if c in baselines.columns]
    keys = ["dcs", *period, "facility", "season"]
    known = with_missing(baselines, {"eligible": "int"}).where(F.coalesce(F.col("eligible").cast("int"), F.lit(1)) != 0)
    all_year = F.col("season") == ALL_YEAR
    enough = F.when(all_year, LIMITS.min_all_year_records).otherwise(LIMITS.min_seasonal_records)
    candidates = known.where(F.col("record_count") >= enough).withColumns({
        "low_seasonal_data": all_year.cast("int"),
        "season": F.explode(F.when(all_year, F.array(*map(F.lit, SEASONS))).otherwise(F.array("season"))),
    })
    best = Window.partitionBy(*keys).orderBy("low_seasonal_data", F.desc("record_count"), *_LOOKUP_VALUES)
    return (
        candidates.withColumn("choice", F.row_number().over(best)).where(F.col("choice") == 1)
        .select(*keys, F.col("record_count").alias("baseline_records"), "low_seasonal_data", *_LOOKUP_VALUES)
    )


def score_records(records: DataFrame, baselines: DataFrame) -> DataFrame:
    """Records that have a usable baseline, with z-scores and raw rule outcomes (before thin suppression)."""
    lookup = baseline_lookup(baselines)
    # dcs first: rows are sorted by the keys in this order, and few rows share a dcs
    keys = [c for c in ["dcs", "file_year", "file_month", "facility", "season"] if c in lookup.columns]
    records = with_missing(clean_measures(records), {"serial_no": "string", "vehicle": "string"})
    joined = records.join(lookup, keys)
    scores = F.struct(
        zscore(F.col("fat_pct"), F.col("fat_pct_mean"), F.col("fat_pct_std")).alias("z_fat"),
        zscore(F.col("snf_pct"), F.col("snf_pct_mean"), F.col("snf_pct_std")).alias("z_snf"),
        zscore(F.col("clr"), F.col("clr_mean"), F.col("clr_std")).alias("z_clr"),
        zscore(F.col("qty"), F.col("qty_mean"), F.col("qty_std")).alias("z_qty"),
        F.col("fat_pct_mean").alias("b_fat"), F.col("snf_pct_mean").alias("b_snf"),
        F.col("clr_mean").alias("b_clr"), F.col("qty_mean").alias("b_qty"),
    )
    # As the output of a generator the scores are computed once; filters on the rules stay above it.
    scored = joined.select("*", F.inline(F.array(scores)))
    # The outcomes likewise: inlined into the filter they fill a method too large for the JVM to compile.
    rules = {RULES[r]: flag(F.expr(c)) for r, c in _CONDITIONS.items()} | {RULES["R8"]: F.lit(0)}
    extreme = any_of([F.abs(F.col(z)) > LIMITS.thin_z for z in ["z_snf", "z_fat", "z_clr"]])
    outcomes = rules | {"thin_baseline": flag(F.col("baseline_records") < LIMITS.thin_records), "extreme_z": flag(extreme)}
    scored = scored.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in outcomes.items()]))))
    return scored.drop(*_LOOKUP_VALUES)


# The seven active rules; R8 is disabled and always 0.
_CONDITIONS = {
    "R1": "z_snf < -2.0D AND snf_pct < 8.0D",
    "R2": "z_snf > 2.0D AND snf_pct > 9.2D",
    "R3": "z_fat < -2.5D AND fat_pct < b_fat - 2.0D",
    "R4": "z_snf > 1.5D AND z_fat < -0.5D AND snf_pct > 9.0D",
    "R5": "z_clr > 2.0D AND clr >= 29",
    "R6": "z_qty > 2.0D AND (z_fat < -1.5D OR z_snf < -1.5D)",
    "R7": "z_clr < -2.0D AND clr < 25",
}


def suppress_thin(scored: DataFrame) -> DataFrame:
    """With a thin baseline the rules count only if a composition z-score is extreme."""
    quiet = (F.col("thin_baseline") == 1) & (F.col("extreme_z") == 0)
    return scored.withColumns({c: F.when(quiet, 0).otherwise(F.col(c)) for c in RULES.values()})


def apply_rules(records: DataFrame, baselines: DataFrame) -> DataFrame:
    """Records on which at least one rule fires, unclassified."""
    return suppress_thin(score_records(records, baselines)).where(
        any_of([F.col(c) == 1 for c in RULES.values()])
    )


# Precedence of the categories: the first entry whose rules all fired decides.
_CATEGORIES = [
    (["R6"], "VOLUME_COMPOSITION_SHIFT", "RESAMPLE", "S6"),
    (["R1", "R7"], "LOW_DENSITY_COMPOSITION_SCREEN", "RESAMPLE", "S1_7"),
    (["R2", "R5"], "HIGH_DENSITY_COMPOSITION_SCREEN", "RESAMPLE", "S2_5"),
    (["R7"], "LOW_DENSITY_SCREEN", "REVIEW", "S7"),
    (["R5"], "HIGH_DENSITY_SCREEN", "REVIEW", "S5"),
    (["R3"], "LOW_FAT_SCREEN", "REVIEW", "S3"),
    (["R1"], "LOW_SOLIDS_SCREEN", "REVIEW", "S1"),
    (["R2"], "HIGH_SOLIDS_SCREEN", "REVIEW", "S2"),
    (["R4"], "COMPOSITION_RELATIONSHIP_SCREEN", "REVIEW", "S4"),
    (["R8"], "LEGACY_RULE_DISABLED", "MONITOR", "S_LEGACY"),
]
_NO_CATEGORY = ("UNCLASSIFIED_SCREENING_SIGNAL", "MONITOR", "S0")


def diagnose(flags: DataFrame) -> DataFrame:
    """Add category, priority and case code."""
    flags = with_missing(flags, {c: "int" for c in RULES.values()})
    names = ["diagnosis", "confidence", "case"]

    def outcome(values) -> Column:
        return F.struct(*[F.lit(v).alias(n) for v, n in zip(values, names)])

    # With lower-priority branches inside: the last entry of the list ends up innermost.
    chosen = outcome(_NO_CATEGORY)
    for fired, *values in reversed(_CATEGORIES):
        hit = F.lit(True)
        for r in fired:
            hit = hit & (F.coalesce(F.col(RULES[r]), F.lit(0)) == 1)
        chosen = F.when(hit, outcome(values)).otherwise(chosen)
    return flags.withColumn("outcome", chosen).select("*", "outcome.*").drop("outcome")


def explain(flags: DataFrame) -> DataFrame:
    """Add the explanation text."""

    def part(label: str, unit: str, value: str, base: str, z: str, digits: int) -> list[Column]:
        return [
            F.lit(f"{label} "), fixed(value, digits), F.lit(f"{unit} (base "), fixed(base, digits),
            F.lit(", z="), fixed(z, 1, signed=True), F.lit(")"),
        ]

    text = F.concat(
        *part("SNF", "%", "snf_pct", "b_snf", "z_snf", 2), F.lit("; "),
        *part("Fat", "%", "fat_pct", "b_fat", "z_fat", 2), F.lit("; "),
        *part("CLR", "", "clr", "b_clr", "z_clr", 1), F.lit("; "),
        *part("QTY", "", "qty", "b_qty", "z_qty", 1),
        F.lit(". Screening category: "), F.col("diagnosis"), F.lit(". Confirmatory testing is required."),
    )
    return flags.withColumn("explanation", text)


def downgraded(priority: Column) -> Column:
    """One step down, MONITOR at the lowest; an unknown priority stays."""
    return F.when(priority == "RESAMPLE", "REVIEW").when(priority == "REVIEW", "MONITOR").otherwise(priority)


def adjust_priority(flags: DataFrame) -> DataFrame:
    """Lower the priority of small samples and of thin same-season history, and note why."""
    flags = with_missing(flags, {"qty": "double", "low_seasonal_data": "int", "explanation": "string"})
    small = F.coalesce(F.col("qty") < LIMITS.low_qty, F.lit(False))
    after_qty = F.when(small, downgraded(F.col("confidence"))).otherwise(F.col("confidence"))
    capped = F.coalesce(F.col("low_seasonal_data") == 1, F.lit(False)) & (after_qty == "RESAMPLE")
    note = F.concat_ws("; ", F.when(small, NOTE_LOW_QTY), F.when(capped, NOTE_THIN_SEASON))
    return (
        flags.withColumns({
            "confidence_base": F.col("confidence"),
            "confidence_note": note,
            "confidence": F.when(capped, "REVIEW").otherwise(after_qty),
        })
        .withColumn(
            "explanation",
            F.when(
                F.col("confidence_note") != "",
                F.concat("explanation", F.lit(" Note: "), "confidence_note", F.lit(".")),
            ).otherwise(F.col("explanation")),
        )
    )


def rules_fired() -> Column:
    """``"R1,R7"`` for a flagged record."""
    return F.concat_ws(",", *[F.when(F.col(c) == 1, r) for r, c in RULES.items()])
