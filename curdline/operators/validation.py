"""Row validation with reasons, and the per-file report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curdline.functions.expressions import any_of, finite, season_of, trimmed
from curdline.schema import CONTRACT_VERSION, FOOTER_LABELS, NUMERIC_COLUMNS, RECORD, REPORT_COLUMNS
from curdline.sources.reports import month_number

# Letters that Spark's cast accepts in a number and a report does not: 1.0d, 1.0f, 0x1p3, inf.
_NOT_IN_NUMBERS = "[dDfFxXpP]"
_TIME = r"(?:[ T]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?\s*$"
_LOOKS_ISO = r"^\s*\d{4}-\d{1,2}-\d{1,2}(\s|$)"
_ISO_DATE = r"^\s*(\d{4}-\d{1,2}-\d{1,2})" + _TIME
# First year of the century that two digits stand for: 69 to 99 are 1969 to 1999.
_LAST_CENTURY = "69"
_SHIFTS = {"M": "M", "MORNING": "M", "E": "E", "EVENING": "E"}
_FILE_COLUMNS = ["source_file", "facility", "file_year", "file_month", "schema_layout", "schema_fingerprint"]


def number(text: Column) -> Column:
    return finite(F.when(~text.rlike(_NOT_IN_NUMBERS), text).try_cast("double"))


def date_text(text: Column) -> Column:
    """A date without its time of day: ISO text as it is, anything else with dashes between its parts."""
    other = F.regexp_replace(F.regexp_replace(text, _TIME, ""), r"[./\s,-]+", "-")
    return F.when(
        text.rlike(_LOOKS_ISO), F.nullif(F.concat(F.lit("iso "), F.regexp_extract(text, _ISO_DATE, 1)), F.lit("iso "))
    ).otherwise(F.regexp_replace(other, "^-", ""))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year, F.lit("-"), month, F.lit("-"), day)


def parsed_date(text: Column) -> Column:
    """Date from ``date_text``: day first, month first only where day first is impossible.

    The three parts are put in order as ISO text and cast, which is cheap and raises nothing for impossible dates.
    """
    parts = F.split(text, "-")
    a, b, c = (F.get(parts, i) for i in range(3))

    def day(part: Column) -> Column:
        return F.when(part.rlike(r"^\d{1,2}$"), part)

    def month(part: Column) -> Column:
        return F.coalesce(day(part), month_number(part).cast("string"))

    def year(part: Column) -> Column:
        century = F.when(part >= _LAST_CENTURY, "19").otherwise("20")
        return F.when(part.rlike(r"^\d{4}$"), part).when(part.rlike(r"^\d{2}$"), F.concat(century, part))

    readings = [(c, b, a), (c, a, b)]
    year_first = [(a, c, b), (a, b, c)]
    mixed = F.coalesce(
        *[_iso(year(y), month(m), day(d)).try_cast("date") for y, m, d in readings],
        *[F.when(F.length(y) == 4, _iso(year(y), month(m), day(d))).try_cast("date") for y, m, d in year_first],
    )
    iso = F.substring(text, 5, 10).try_cast("date")
    return F.when(text.startswith("iso "), iso).when(F.size(parts) == 3, mixed)


def canonical_shift(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in _SHIFTS.items() for x in pair])
    return F.try_element_at(known, F.upper(trimmed(text)))


def data_rows(raw: DataFrame) -> DataFrame:
    """Rows that hold data: blank rows and unnumbered footer rows are left out, a numbered TOTAL row is not."""
    filled = any_of([_filled(c) for c in REPORT_COLUMNS if c != "serial_no"])
    footer = F.col("serial_no").isNull() & F.upper(trimmed(F.coalesce("society_name", F.lit("")))).isin(FOOTER_LABELS)
    return raw.where((F.col("serial_no").isNotNull() | filled) & ~footer)


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).rlike(r"\S"), F.lit(False))


def validate(raw: DataFrame) -> DataFrame:
    """Data rows with typed columns and ``rejection_reason`` (empty when accepted)."""
    # As the output of a generator a parsed cell is computed once; filters on the reason stay above it.
    cells = F.struct(
        *[number(F.col(c)).alias(f"{c}_number") for c in NUMERIC_COLUMNS],
        date_text(F.col("date")).alias("date_text"), canonical_shift(F.col("shift")).alias("canonical_shift"),
    )
    rows = data_rows(raw).select("*", F.inline(F.array(cells)))
    rows = rows.select("*", F.explode(F.array(parsed_date(F.col("date_text")))).alias("parsed_date"))

    checks = [
        (~_filled("serial_no"), "missing_serial_no"),
        (F.col("parsed_date").isNull(), "missing_or_invalid_date"),
        *[(F.col(f"{c}_number").isNull(), f"missing_or_invalid_{c}") for c in ["dcs", "fat_pct", "snf_pct", "clr", "qty"]],
        (F.col("canonical_shift").isNull(), "missing_or_invalid_shift"),
        (~_filled("society_name"), "missing_society_name"),
    ]
    reasons = F.concat_ws("; ", *[F.when(bad, reason) for bad, reason in checks])
    return rows.withColumn("rejection_reason", reasons)


def accepted(validated: DataFrame) -> DataFrame:
    """Canonical records in the order of ``schema.RECORD``."""
    return validated.where(F.col("rejection_reason") == "").withColumns({
        **{c: F.col(f"{c}_number") for c in NUMERIC_COLUMNS},
        "date": F.col("parsed_date"),
        "shift": F.col("canonical_shift"),
        "society_name": trimmed(F.col("society_name")),
        "vehicle": trimmed(F.col("vehicle")),
        "season": season_of(F.col("file_month")),
    }).select(*RECORD.names)


def rejected(validated: DataFrame) -> DataFrame:
    """Rejected rows as read, with their row number and reason."""
    return validated.where(F.col("rejection_reason") != "").select(
        "source_file", "source_row", "facility", "file_month", "file_year", *REPORT_COLUMNS, "rejection_reason"
    )


def rejection_counts(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("rejection_reason") != "").groupBy("source_file", "rejection_reason").agg(
        F.count(F.lit(1)).alias("rows")
    )


def validation_report(raw: DataFrame, validated: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per file: rows seen, data rows, accepted, rejected, counts per reason.

    ``files`` is the catalogue; with it, files of unknown layout or without rows are listed too, with counts of 0.
    """
    seen = raw.groupBy(*_FILE_COLUMNS).agg(F.count(F.lit(1)).alias("rows_seen"))
    if files is not None:
        seen = files.select(*_FILE_COLUMNS).join(seen.select("source_file", "rows_seen"), "source_file", "left")
    bad = F.col("rejection_reason") != ""
    checked = validated.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("data_rows_seen"), F.count_if(~bad).alias("accepted_rows"),
        F.count_if(bad).alias("rejected_rows"),
        F.count_if(F.col("parsed_date").isNotNull() & (
            (F.year("parsed_date") != F.col("file_year")) | (F.month("parsed_date") != F.col("file_month"))
        )).alias("rows_outside_period"),
    )
    # At most 2^9 - 1 different reason texts exist, so the map per file is bounded.
    reasons = rejection_counts(validated).groupBy("source_file").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("rejection_reason", "rows")))).alias("rejection_counts")
    )
    joined = seen.join(checked, "source_file", "left").join(reasons, "source_file", "left")
    counts = ["rows_seen", "data_rows_seen", "accepted_rows", "rejected_rows", "rows_outside_period"]
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts}).withColumn(
        "contract_version", F.lit(CONTRACT_VERSION)
    )


def preview(rows: DataFrame, limit: int = 20) -> DataFrame:
    """First rows of each file in source order."""
    first = Window.partitionBy("source_file").orderBy("source_row")
    return rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit).drop("place")


def strict_failures(report: DataFrame) -> DataFrame:
    """Files that the strict gate refuses: any rejected row, or no accepted one."""
    return report.where((F.col("rejected_rows") > 0) | (F.col("accepted_rows") == 0))


def only_clean_files(records: DataFrame, report: DataFrame) -> DataFrame:
    """Per-file option of the gate: records of refused files are left out."""
    return records.join(strict_failures(report).select("source_file"), "source_file", "left_anti")
