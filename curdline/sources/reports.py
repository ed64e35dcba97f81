"""Report exports: discovery, file identity, layouts and row numbers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curdline.functions.expressions import trimmed
from curdline.schema import LAYOUTS, MONTH_NAMES, REPORT_COLUMNS, REQUIRED_COLUMNS

_PERIOD_PATTERN = r"(?i)month of\s+([A-Za-z]+)\s+(\d{4})"
_QUOTED_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
# Above this many file splits the per-split table is joined by shuffle instead of broadcast.
_BROADCAST_SPLITS = 200_000


def month_number(token: Column) -> Column:
    """1-12 for a full English month name, its first three letters, or ``sept``; null otherwise."""
    numbers: dict[str, int] = {"sept": 9}
    for i, name in enumerate(MONTH_NAMES, start=1):
        numbers |= {name: i, name[:3]: i}
    pairs = [F.lit(x) for item in numbers.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(token))


def file_identity(file_name: Column) -> Column:
    """Struct (facility, file_month, file_year) from a base name; null if it names no month."""
    month = month_number(F.regexp_extract(file_name, _PERIOD_PATTERN, 1))
    year = F.regexp_extract(file_name, _PERIOD_PATTERN, 2)
    facility = F.regexp_extract(file_name, r"^\s*(\S+)", 1)
    return F.when(
        month.isNotNull(),
        F.struct(facility.alias("facility"), month.alias("file_month"), year.try_cast("int").alias("file_year")),
    )


def stripped_header(header: Column) -> Column:
    return F.transform(header, trimmed)


def schema_fingerprint(header: Column) -> Column:
    """First 16 hex digits of the SHA-256 over the stripped header names."""
    return F.substring(F.sha2(F.array_join(stripped_header(header), "\n"), 256), 1, 16)


def layout_of(header: Column) -> Column:
    """Name of the first layout whose required columns are all present, or null."""
    names = stripped_header(header)
    found = None
    for layout, columns in LAYOUTS.items():
        needed = F.array(*[F.lit(src) for src, dst in columns.items() if dst in REQUIRED_COLUMNS])
        hit = F.size(F.array_except(needed, names)) == 0
        found = F.when(hit, layout) if found is None else found.when(hit, layout)
    return found


def _cell_position(header: Column, layout: Column, target: str) -> Column:
    """0-based position of a canonical column in the header; null where the layout or column is absent."""
    names = stripped_header(header)
    position = None
    for name, columns in LAYOUTS.items():
        source = next(src for src, dst in columns.items() if dst == target)
        here = F.nullif(F.array_position(names, F.lit(source)), F.lit(0)).cast("int") - 1
        position = F.when(layout == name, here) if position is None else position.when(layout == name, here)
    return position


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line; quotes removed, empty cells null. A quoted cell may hold commas, not line ends."""
    plain = F.split(line, ",", -1)
    quoted = F.transform(
        F.split(line, _QUOTED_COMMA, -1),
        lambda c: F.replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"')),
    )
    cells = F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)
    return F.transform(cells, lambda c: F.nullif(c, F.lit("")))


def _file_path() -> Column:
    """The path of a row's file, spelt alike by every scan."""
    return F.col("_metadata.file_path")


def _decoded_name() -> Column:
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def report_catalogue(spark: SparkSession, source_dir: str, glob: str = "*.csv") -> DataFrame:
    """One row per file that names a period: path, length, source_file and identity. No file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(source_dir)
    named = found.select("path", "length", _decoded_name().alias("source_file"))
    return named.withColumn("identity", file_identity(F.col("source_file"))).where(F.col("identity").isNotNull()).select(
        "path", "length", "source_file", "identity.*"
    )


def _listed(catalogue: DataFrame) -> list[str]:
    """The paths of a catalogue, which a scan needs on the driver: Spark keeps the list of a scan's files there."""
    return [r["path"] for r in catalogue.select("path").collect()]


def _numbered_lines(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Lines of catalogued files with split-local ids, one row per file split, and a bound for the number of splits."""
    split = int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"))
    listed = files.select("path", (F.ceil(F.col("length") / split) + 1).alias("splits")).collect()
    scan = spark.read.text([r["path"] for r in listed]) if listed else spark.createDataFrame([], "value string")
    if not listed:
        columns = "value string, path string, block_start bigint, source_file string, line_id bigint"
        lines = spark.createDataFrame([], columns)
    else:
        lines = scan.select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            _decoded_name().alias("source_file"),
            F.monotonically_increasing_id().alias("line_id"),
        )
    # only the start of a file can hold its header; other splits are counted without their text
    splits = lines.groupBy("path", "block_start", "source_file").agg(
        F.min("line_id").alias("first_id"), F.count(F.lit(1)).alias("lines"),
        F.min_by(F.when(F.col("block_start") == 0, F.col("value")), "line_id").alias("header_line"),
    )
    return lines, splits, sum(r["splits"] for r in listed)


def _files_with_offsets(splits: DataFrame) -> DataFrame:
    """Each split with the lines before it and what its file's name and header say, which is read once for each file."""
    in_file = Window.partitionBy("path").orderBy("block_start")
    header = csv_cells(F.regexp_replace(F.col("header_line"), "^﻿", ""))
    told = splits.withColumn("header", F.transform(header, lambda c: F.coalesce(c, F.lit("")))).withColumns({
        "identity": F.when(F.col("header").isNotNull(), file_identity(F.col("source_file"))),
        "schema_layout": layout_of(F.col("header")),
        "schema_fingerprint": schema_fingerprint(F.col("header")),
    })
    told = told.withColumn(
        "positions",
        F.struct(*[_cell_position(F.col("header"), F.col("schema_layout"), c).alias(c) for c in REPORT_COLUMNS]),
    )
    file = F.struct("identity", "schema_layout", "schema_fingerprint", "positions")
    return told.select(
        "path", "block_start", "source_file", "first_id",
        F.coalesce(F.sum("lines").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lines_before"),
        F.first(file).over(in_file).alias("file"),
    ).select("*", "file.*").drop("file")


def report_files(spark: SparkSession, source_dir: str, glob: str = "*.csv") -> DataFrame:
    """Catalogue of report files: identity, layout and fingerprint, one row per file."""
    return catalogued_files(spark, report_catalogue(spark, source_dir, glob))


def catalogued_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The same for the files of a catalogue."""
    _, splits, _ = _numbered_lines(spark, files)
    return _files_with_offsets(splits).where(F.col("lines_before") == 0).select(
        "source_file", "identity.*", "schema_layout", "schema_fingerprint"
    )


def scan_csv_reports(spark: SparkSession, source_dir: str, glob: str = "*.csv", files: DataFrame | None = None) -> DataFrame:
    """Raw rows of all report files below ``source_dir``, or of those of a catalogue, as text in canonical columns.

    One scan serves files of both layouts and any column order. Row numbers are exact and need no task per
    file: a line's number is its place in its split plus the lines of the file's earlier splits. Files whose
    name gives no period are skipped; files of unknown layout keep no rows (``report_files`` lists them).
    """
    lines, splits, most = _numbered_lines(spark, report_catalogue(spark, source_dir, glob) if files is None else files)
    known = _files_with_offsets(splits).where(F.col("identity").isNotNull() & F.col("schema_layout").isNotNull())
    known = known.select(
        "path", "block_start", "first_id", "lines_before", "identity.*", "schema_layout", "schema_fingerprint",
        "positions",
    )
    if most <= _BROADCAST_SPLITS:
        known = F.broadcast(known)
    rows = (
        lines.join(known, ["path", "block_start"])
        .withColumn("source_row", F.col("lines_before") + F.col("line_id") - F.col("first_id") + 1)
        .where(F.col("source_row") > 1)
        .withColumn("cells", csv_cells(F.col("value")))
    )
    return rows.select(
        "source_file", "source_row", "facility", "file_month", "file_year", "schema_layout", "schema_fingerprint",
        *[F.get("cells", F.col(f"positions.{c}")).alias(c) for c in REPORT_COLUMNS],
    )


def map_columns(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rename the columns of one raw frame to canonical names; unknown columns are dropped, absent ones null."""
    headers = {name.strip(): name for name in df.columns}
    for columns in LAYOUTS.values():
        required = [src for src, dst in columns.items() if dst in REQUIRED_COLUMNS]
        if all(src in headers for src in required):
            break
    else:
        header = F.array(*[F.lit(c) for c in df.columns])
        mark = df.sparkSession.range(1).select(schema_fingerprint(header).alias("f")).first()["f"]
        raise ValueError(
            f"Unsupported report layout (fingerprint {mark}). Use a documented layout or add a new one."
        )

    def cell(source: str, target: str) -> Column:
        present = df[f"`{headers[source]}`"] if source in headers else F.lit(None)
        return present.cast("string").alias(target)

    return df.select(*(keep or []), *[cell(src, dst) for src, dst in columns.items()])


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        headers = [pq.read_schema(pa.BufferReader(c.as_buffer())).names for c in batch.column("content")]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(headers, pa.list_(pa.string()))], names=["path", "header"])


def parquet_headers(spark: SparkSession, source_dir: str, files: DataFrame | None = None, glob: str = "*.parquet") -> DataFrame:
    """(path, header): column names of each Parquet export, from its own footer."""
    paths = _listed(report_catalogue(spark, source_dir, glob) if files is None else files)
    if not paths:
        return spark.createDataFrame([], "path string, header array<string>")
    content = spark.read.format("binaryFile").load(paths).select("path", "content")
    return content.mapInArrow(_footers, "path string, header array<string>")


def scan_parquet_reports(spark: SparkSession, source_dir: str, files: DataFrame | None = None) -> DataFrame:
    """Raw rows of Parquet exports; every file has its own header, and the file format itself numbers the rows.

    Files with the same header are one scan; there are few headers. Files whose header fits no layout keep no rows.
    What a file's name says is read once for each file and joined to its rows.
    """
    headers = parquet_headers(spark, source_dir, files).groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    paths = [p for row in headers for p in row["paths"]]
    if paths:
        # a path that a catalogue names twice is still one file
        known = spark.read.format("binaryFile").load(paths).select(_file_path().alias("report_path"), _decoded_name().alias("source_file")).dropDuplicates(["report_path"])
        known = known.withColumn("identity", file_identity(F.col("source_file")))
        if len(paths) <= _BROADCAST_SPLITS:
            known = F.broadcast(known)
    scans = []
    for row in headers:
        if not any(all(src in {h.strip() for h in row["header"]} for src, dst in columns.items() if dst in REQUIRED_COLUMNS) for columns in LAYOUTS.values()):
            continue
        df = spark.read.parquet(*row["paths"])
        header = F.array(*[F.lit(h.strip()) for h in row["header"]])
        numbered = df.withColumns({"report_path": _file_path(), "source_row": F.col("_metadata.row_index") + 2})
        mapped = map_columns(numbered, ["report_path", "source_row"])
        scans.append(mapped.join(known, "report_path").select(
            "source_file", "source_row", "identity.*", layout_of(header).alias("schema_layout"),
            schema_fingerprint(header).alias("schema_fingerprint"),
            *[F.col(c) if c in mapped.columns else F.lit(None).cast("string").alias(c) for c in REPORT_COLUMNS],
        ))
    if not scans:
        names = "source_file string, source_row bigint, facility string, file_month int, file_year int, schema_layout string, schema_fingerprint string, "
        return spark.createDataFrame([], names + ", ".join(f"{c} string" for c in REPORT_COLUMNS))
    return reduce(DataFrame.unionByName, scans)
