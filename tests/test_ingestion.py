from __future__ import annotations

import csv
import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from curdline.operators import validation
from curdline.plans.validation import inspect, load_records
from curdline.schema import LAYOUT_A, LAYOUT_B, PERIOD
from curdline.sources import reports

A = list(LAYOUT_A)
B = list(LAYOUT_B)
GOOD = ["1", "tank 2", "01-04-2026", "Morning", "7", "Mill Lane", "60", "4.5", "8.75", "28.25", "3", "5", "31", "1900"]


def write(folder, name, header, rows):
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / name, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *rows])


def good(**changes):
    row = dict(zip(LAYOUT_A.values(), GOOD)) | changes
    return list(row.values())


def raw(spark, rows):
    """Raw canonical rows without a file around them."""
    names = list(LAYOUT_A.values())
    data = [tuple(r) + ("f.csv", i, "Hillside", 4, 2026, "layout_a", "x") for i, r in enumerate(rows, start=2)]
    ddl = ", ".join(f"{n} string" for n in names) + (
        ", source_file string, source_row bigint, facility string, file_month int, file_year int,"
        " schema_layout string, schema_fingerprint string")
    return spark.createDataFrame(data, ddl)


def reasons(spark, rows):
    found = validation.validate(raw(spark, rows)).orderBy("source_row").collect()
    return [r["rejection_reason"] for r in found]


@pytest.mark.parametrize(("name", "expected"), [
    ("Hillside milk collection for the month of March 2026.xls", ("Hillside", 3, 2026)),
    ("Lakeview milk collection report for the month of Sept 2025.xls", ("Lakeview", 9, 2025)),
    ("Moorgate milk collection report For the Month of July 2025.xls", ("Moorgate", 7, 2025)),
    ("Northam month of dec 2024.csv", ("Northam", 12, 2024)),
    ("Facility month of Foo 2026.xlsx", None),
    ("Facility report.csv", None),
])
def test_file_identity(spark, name, expected):
    got = spark.range(1).select(reports.file_identity(F.lit(name)).alias("i")).first()["i"]
    assert (None if got is None else tuple(got)) == expected


def test_fingerprint_and_layouts(spark):
    header = [f"  {h} " for h in A]
    df = spark.createDataFrame([(header,), (B[::-1] + ["Data"],), (A[:5],)], "h array<string>")
    got = df.select(reports.layout_of(F.col("h")), reports.schema_fingerprint(F.col("h"))).collect()
    assert [r[0] for r in got] == ["layout_a", "layout_b", None]
    assert got[0][1] == hashlib.sha256("\n".join(A).encode()).hexdigest()[:16]


def test_both_layouts_in_one_scan(spark, tmp_path):
    write(tmp_path / "x", "Lakeview milk for the month of April 2026.csv", [f" {h} " for h in A] + ["Unnamed: 17"],
          [good(vehicle=" 12 ", society_name="  Al, \"pha\"  ") + ["ignored"], ["", "", "", "", "", "TOTAL", "100"] + [""] * 8])
    shuffled = B[::-1]
    row = dict(zip(B, ["7", " V9 ", "01-01-2026", "Evening", "20", "  Beta  ", "200", "6.2", "8.9", "29", "12.4", "17.8", "42", "8400"]))
    write(tmp_path / "y" / "z", "Facility+One report for the month of Jan 2026.csv", shuffled, [[row[h] for h in shuffled]])
    write(tmp_path, "no period here.csv", A, [GOOD])
    got = {r["facility"]: r for r in load_records(spark, str(tmp_path)).collect()}
    assert set(got) == {"Lakeview", "Facility+One"}
    first, second = got["Lakeview"], got["Facility+One"]
    assert (first["society_name"], first["vehicle"], first["shift"], first["season"]) == ('Al, "pha"', "12", "M", "summer")
    assert (second["society_name"], second["vehicle"], second["shift"], second["season"]) == ("Beta", "V9", "E", "winter")
    assert (second["qty"], second["fat_pct"], second["clr"], second["dcs"], second["amount"]) == (200, 6.2, 29, 20, 8400)
    assert second["date"] == dt.date(2026, 1, 1) and second["source_row"] == 2


def test_row_numbers_over_many_splits(spark, tmp_path):
    for facility in "AB":
        rows = [good(serial_no=str(i), society_name=f"Society {i % 7}") for i in range(2, 802)]
        write(tmp_path, f"{facility} for the month of April 2026.csv", A, rows)
    keep = {k: spark.conf.get(k) for k in ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = reports.scan_csv_reports(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 10
        rows = got.select("facility", "source_row", "serial_no").collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(rows) == 1600
    assert all(int(r["serial_no"]) == r["source_row"] for r in rows)


def test_many_splits_are_few_tasks(spark, tmp_path):
    """Splits of 16 KB share tasks: the stored rows are as few files, and each row keeps its number."""
    numbers = [str(i) for i in range(8_000)]
    write(tmp_path, "Hillside month of April 2026.csv", A, [good(serial_no=i) for i in numbers])
    write(tmp_path, "Lakeview month of May 2026.csv", A, [good(serial_no=i) for i in numbers[:10]])
    before = [spark.conf.get(f"spark.sql.files.{c}", None) for c in ("maxPartitionBytes", "maxPartitionNum")]
    stored = entry._over_many_splits(
        spark, str(tmp_path), lambda: reports.scan_csv_reports(spark, str(tmp_path)).select("facility", "source_row", "serial_no", "rate")
    )
    assert (tmp_path / "Hillside month of April 2026.csv").stat().st_size > 24 * (1 << 14)
    assert len(stored.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    found = {(r["facility"], r["source_row"]): (r["serial_no"], r["rate"]) for r in stored.collect()}
    rate = GOOD[list(LAYOUT_A.values()).index("rate")]
    assert found == {(f, i + 2): (str(i), rate) for f, n in (("Hillside", 8_000), ("Lakeview", 10)) for i in range(n)}
    assert before == [spark.conf.get(f"spark.sql.files.{c}", None) for c in ("maxPartitionBytes", "maxPartitionNum")]


def test_reasons_in_fixed_order(spark):
    assert reasons(spark, [
        good(), good(qty="not-a-number"), good(serial_no=None), good(serial_no=" "),
        good(shift="Night"), good(fat_pct="inf"), good(date="not-a-date"),
        [None] * 5 + ["Partial", "100"] + [None] * 7,
        good(kg_fat="bad", rate="x", amount=None), good(qty="1,000"), good(qty="1.0d"), good(clr="nan"),
        good(serial_no="9", society_name="TOTAL"), good(society_name="  "),
    ]) == [
        "", "missing_or_invalid_qty", "missing_serial_no", "missing_serial_no",
        "missing_or_invalid_shift", "missing_or_invalid_fat_pct", "missing_or_invalid_date",
        "missing_serial_no; missing_or_invalid_date; missing_or_invalid_dcs; missing_or_invalid_fat_pct; "
        "missing_or_invalid_snf_pct; missing_or_invalid_clr; missing_or_invalid_shift",
        "", "missing_or_invalid_qty", "missing_or_invalid_qty", "missing_or_invalid_clr", "", "missing_society_name",
    ]


def test_blank_and_footer_rows_are_no_data(spark):
    rows = [[None] * 14, ["", *[" "] * 13], [None] * 5 + [" grand total ", "5"] + [None] * 7, good()]
    found = validation.data_rows(raw(spark, rows)).select("source_row").collect()
    # A blank but present serial keeps a row; the reader itself turns empty cells into nulls.
    assert [r[0] for r in found] == [3, 5]


@pytest.mark.parametrize(("text", "expected"), [
    ("2026-04-01", dt.date(2026, 4, 1)), ("2026-4-1 00:00:00", dt.date(2026, 4, 1)), ("01/04/2026", dt.date(2026, 4, 1)),
    (" 1.4.2026 ", dt.date(2026, 4, 1)), ("01-Apr-2026", dt.date(2026, 4, 1)), ("1 April 2026", dt.date(2026, 4, 1)),
    ("13/04/2026", dt.date(2026, 4, 13)), ("04/13/2026", dt.date(2026, 4, 13)), ("31-04-2026", None), ("2026-13-01", None),
    ("01-04-26", dt.date(2026, 4, 1)), ("Apr 1, 2026", dt.date(2026, 4, 1)), ("01-04-2026 10:30", dt.date(2026, 4, 1)),
    ("2026-04-01 noon", None), ("", None), (None, None),
])
def test_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(validation.parsed_date(validation.date_text(F.col("t"))).alias("d")).first()["d"] == expected


def test_validation_report_gate_and_preview(spark, tmp_path):
    bad = [good(serial_no=str(i), qty="x") for i in range(30)]
    write(tmp_path, "A for the month of April 2026.csv", A, [good(date="01-05-2026"), *bad, ["", "", "", "", "", "TOTAL"] + [""] * 8])
    write(tmp_path, "B for the month of April 2026.csv", A, [good(), good(serial_no="2")])
    got = {r["source_file"][0]: r for r in inspect(spark, str(tmp_path)).collect()}
    assert [got["A"][c] for c in ["rows_seen", "data_rows_seen", "accepted_rows", "rejected_rows", "rows_outside_period"]] == [32, 31, 1, 30, 1]
    assert got["A"]["rejection_counts"] == {"missing_or_invalid_qty": 30}
    assert got["B"]["accepted_rows"] == 2 and got["B"]["contract_version"] == "collection-workbook-v1"
    with pytest.raises(ValueError, match="rejected data row"):
        load_records(spark, str(tmp_path))
    assert {r["facility"] for r in load_records(spark, str(tmp_path), skip_bad_files=True).collect()} == {"B"}
    checked = validation.validate(reports.scan_csv_reports(spark, str(tmp_path)))
    shown = validation.preview(validation.rejected(checked), 5).orderBy("source_row").collect()
    assert [r["source_row"] for r in shown] == [3, 4, 5, 6, 7]


def test_unknown_layout_names_its_fingerprint(spark, tmp_path):
    write(tmp_path, "A for the month of April 2026.csv", ["x", "y"], [["1", "2"]])
    mark = hashlib.sha256(b"x\ny").hexdigest()[:16]
    with pytest.raises(ValueError, match=mark):
        load_records(spark, str(tmp_path))
    with pytest.raises(ValueError, match=mark):
        reports.map_columns(spark.createDataFrame([("1", "2")], "x string, y string"))
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        write(tmp_path / "empty", "nothing.csv", A, [])
        load_records(spark, str(tmp_path / "empty"))


def test_parquet_exports_by_their_own_headers(spark, tmp_path):
    """One folder: layout A with spaces around its names, layout B in another order, too few columns, no period."""
    import pandas as pd

    def export(name, columns, rows):
        pd.DataFrame(rows, columns=columns).to_parquet(tmp_path / f"{name}.parquet")

    export("Hillside for the month of May 2026", [f" {h} " for h in A], [GOOD, good(serial_no="2", qty="7")])
    order = [dict(zip(LAYOUT_B.values(), LAYOUT_B, strict=True))[c] for c in reversed(LAYOUT_A.values())]
    export("Lakeview for the month of June 2026", [*order, "Unnamed: 17"], [[*reversed(good(qty="8")), "x"]])
    export("Moorgate for the month of July 2026", A[:5], [GOOD[:5]])
    export("no period", A, [GOOD])
    raw = reports.scan_parquet_reports(spark, str(tmp_path))
    rows = validation.accepted(validation.validate(raw)).orderBy("facility", "source_row").collect()
    assert [(r["facility"], r["file_month"], r["source_row"], r["qty"], r["society_name"]) for r in rows] == [
        ("Hillside", 5, 2, 60.0, "Mill Lane"), ("Hillside", 5, 3, 7.0, "Mill Lane"), ("Lakeview", 6, 2, 8.0, "Mill Lane")]
    assert {(r["facility"], r["schema_layout"]) for r in raw.collect()} == {("Hillside", "layout_a"), ("Lakeview", "layout_b")}
    (tmp_path / "empty").mkdir()
    assert reports.scan_parquet_reports(spark, str(tmp_path / "empty")).collect() == []


def test_names_of_parquet_exports_are_read_once_for_each_file(spark, tmp_path):
    """Nothing above the scan of the rows, up to the join with the files, decodes or parses their names."""
    import pandas as pd

    odd = "Hill%20side+ for the month of May 2026"
    for name, quantity in ((odd, "7"), ("Lakeview for the month of Sept 2025", "8")):
        pd.DataFrame([[*GOOD[:-1], "x"], good(qty=quantity)], columns=A).to_parquet(tmp_path / f"{name}.parquet")
    raw = reports.scan_parquet_reports(spark, str(tmp_path))
    assert sorted((r["source_file"], r["facility"], r["file_month"], r["file_year"], r["source_row"]) for r in raw.collect()) == [
        (f"{odd}.parquet", "Hill%20side+", 5, 2026, 2), (f"{odd}.parquet", "Hill%20side+", 5, 2026, 3),
        ("Lakeview for the month of Sept 2025.parquet", "Lakeview", 9, 2025, 2), ("Lakeview for the month of Sept 2025.parquet", "Lakeview", 9, 2025, 3)]
    lines = raw._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depths = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    scans = [i for i, line in enumerate(lines) if line.endswith("parquet")]
    assert scans
    for at in scans:
        depth = depths[at]
        for i in range(at, -1, -1):
            if depths[i] < depth or i == at:
                depth = depths[i]
                assert "url_decode" not in lines[i].lower() and "regexp_extract" not in lines[i], lines[i]


def test_files_of_done_periods_are_never_opened(spark, tmp_path):
    """A file whose period has a document may even be unreadable; the plan lists the new files only."""
    from curdline.plans.validation import new_files
    from curdline.schema import BUNDLE
    from curdline.sources import tables

    source, state = tmp_path / "reports", str(tmp_path / "state")
    for month in ("May", "June", "July"):
        write(source / month, f"Hillside for the month of {month} 2026.csv", A, [GOOD, good(serial_no="2")])
    tables.upsert(spark, f"{state}/report_bundles", spark.createDataFrame(
        [("Hillside", 2026, 5, "seed_only", "{}"), ("ALL", 2026, 6, "seed_only", "{}")], BUNDLE), PERIOD)
    fresh = new_files(spark, str(source), state)
    assert [r["source_file"] for r in fresh.collect()] == ["Hillside for the month of July 2026.csv"]
    (source / "May" / "Hillside for the month of May 2026.csv").write_bytes(b"\xff\x00 broken")
    raw = reports.scan_csv_reports(spark, "", files=fresh)
    assert {f.rsplit("%20", 2)[-2] for f in raw.inputFiles()} == {"July"}
    records = load_records(spark, str(source), files=fresh)
    assert sorted((r["file_month"], r["source_row"]) for r in records.collect()) == [(7, 2), (7, 3)]
    with pytest.raises(FileNotFoundError):
        load_records(spark, str(source), files=fresh.where("file_month = 1"))
