"""Validation of report files (E2) and loading with the strict gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curdline.operators import merge, validation
from curdline.schema import BUNDLE
from curdline.sources import reports, tables


def inspect(spark: SparkSession, source_dir: str, glob: str = "*.csv") -> DataFrame:
    """One row of diagnostics per file that names a period; reading stops at no bad row or unknown layout."""
    raw = reports.scan_csv_reports(spark, source_dir, glob)
    files = reports.report_files(spark, source_dir, glob).where("facility IS NOT NULL")
    return validation.validation_report(raw, validation.validate(raw), files)


def new_files(spark: SparkSession, source_dir: str, state_dir: str, glob: str = "*.csv") -> DataFrame:
    """The catalogue without the files of periods that have a document; these files are never opened."""
    done = tables.read_table(spark, f"{state_dir.rstrip('/')}/report_bundles", BUNDLE)
    return merge.only_new_periods(reports.report_catalogue(spark, source_dir, glob), done)


def load_records(
    spark: SparkSession, source_dir: str, glob: str = "*.csv", skip_bad_files: bool = False, files: DataFrame | None = None
) -> DataFrame:
    """Records of all report files, or of those of a catalogue such as :func:`new_files`.

    By default one rejected row fails the load, as does a file of unknown layout or without data. With ``skip_bad_files``
    such files are left out instead. Files are parsed once: the checked rows are stored, and all else reads them.
    """
    catalogue = reports.report_catalogue(spark, source_dir, glob) if files is None else files
    if catalogue.isEmpty():
        raise FileNotFoundError(f"No readable report files found in {source_dir}")
    raw = tables.materialized(reports.scan_csv_reports(spark, source_dir, glob, catalogue), "raw_reports")
    validated = tables.materialized(validation.validate(raw), "validated")
    known = reports.catalogued_files(spark, catalogue)
    report = validation.validation_report(raw, validated, known)
    if skip_bad_files:
        return validation.only_clean_files(validation.accepted(validated), report)
    unknown = known.where(F.col("schema_layout").isNull()).limit(5).collect()
    if unknown:
        named = "; ".join(f"{r['source_file']} (fingerprint {r['schema_fingerprint']})" for r in unknown)
        raise ValueError(f"Unsupported report layout: {named}")
    failures = validation.strict_failures(report).limit(5).collect()
    if failures:
        named = "; ".join(f"{r['source_file']}: {r['rejected_rows']} rejected data row(s) of {r['data_rows_seen']}" for r in failures)
        raise ValueError(f"Reports need correction before loading: {named}")
    return validation.accepted(validated)
