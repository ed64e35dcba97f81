"""Views over the driver tables: collection records, raw report rows and report headers.

The texts are valid in Spark SQL and in DuckDB, so queries and their oracle read the same rows.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curdline.schema import LAYOUT_A, LAYOUT_B

RECORDS_SQL = """
WITH b AS (
  SELECT l.*, l_orderkey*7 + l_linenumber*3 + l_partkey AS h,
         year(l_shipdate) AS y, month(l_shipdate) AS m, day(l_shipdate) AS d,
         CAST(floor((day(l_shipdate)-1)/7) AS INT) AS w
  FROM lineitem l),
e AS (
  SELECT b.*, (l_suppkey % 4 = 0 AND m = 7 AND w = 1) AS shared FROM b)
SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'FacilityA' ELSE 'FacilityB' END AS facility,
  l_orderkey*10 + l_linenumber AS serial_no,
  CAST(l_suppkey AS DOUBLE) AS dcs,
  s_name AS society_name,
  make_date(CAST(y AS INT), CAST(m AS INT), CAST(1 + 7*w AS INT)) AS date,
  CASE WHEN l_linenumber % 2 = 0 THEN 'E' ELSE 'M' END AS shift,
  CAST(round(CASE WHEN h % 47 = 0 THEN 5 WHEN h % 47 = 1 OR h % 59 = 2 THEN 300
             ELSE 60 + l_quantity END, 2) AS DOUBLE) AS qty,
  round(5.0 + (l_tax-0.04)*10
        + CASE WHEN h % 61 = 0 THEN -3.0 WHEN h % 59 = 2 THEN -2.5 ELSE 0.0 END, 2) AS fat_pct,
  round(8.6 + (l_discount-0.05)*4
        + CASE WHEN h % 53 IN (0,2) THEN -1.6 WHEN h % 53 IN (1,4) THEN 1.4
               WHEN shared THEN -1.6 ELSE 0.0 END, 2) AS snf_pct,
  round(28.0 + (l_discount-0.05)*10
        + CASE WHEN h % 53 IN (0,3) THEN -5.0 WHEN h % 53 IN (1,5) THEN 4.0
               WHEN shared THEN -5.0 ELSE 0.0 END, 2) AS clr,
  CAST(y AS INT) AS file_year, CAST(m AS INT) AS file_month,
  CASE WHEN m BETWEEN 4 AND 9 THEN 'summer' ELSE 'winter' END AS season
FROM e JOIN supplier ON l_suppkey = s_suppkey
"""

# Raw report rows as text: one row per delivery, with the defects a report can have, chosen by the row's hash.
RAW_ROWS_SQL = """
WITH b AS (
  SELECT l_orderkey*7 + l_linenumber*3 + l_partkey AS h, l_orderkey, l_linenumber, l_suppkey, l_quantity,
         l_tax, l_discount, l_extendedprice, year(l_shipdate) AS y, month(l_shipdate) AS m, day(l_shipdate) AS d,
         s_name
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
t AS (
  SELECT b.*, CASE WHEN l_suppkey % 2 = 0 THEN 'FacilityA' ELSE 'FacilityB' END AS facility,
         concat(lpad(CAST(d AS VARCHAR(2)), 2, '0'), '-', lpad(CAST(m AS VARCHAR(2)), 2, '0'), '-',
                CAST(y AS VARCHAR(4))) AS day_first,
         concat(CAST(y AS VARCHAR(4)), '-', lpad(CAST(m AS VARCHAR(2)), 2, '0'), '-',
                lpad(CAST(d AS VARCHAR(2)), 2, '0')) AS iso
  FROM b)
SELECT facility, CAST(y AS INT) AS file_year, CAST(m AS INT) AS file_month,
  concat(facility, ' milk collection for the month of ',
         CASE m WHEN 1 THEN 'January' WHEN 2 THEN 'Feb' WHEN 3 THEN 'MARCH' WHEN 4 THEN 'april' WHEN 5 THEN 'May'
                WHEN 6 THEN 'Jun' WHEN 7 THEN 'July' WHEN 8 THEN 'aug' WHEN 9 THEN 'Sept' WHEN 10 THEN 'October'
                WHEN 11 THEN 'Nov' ELSE 'December' END,
         ' ', CAST(y AS VARCHAR(4)), '.csv') AS source_file,
  l_orderkey*10 + l_linenumber AS source_row,
  CASE WHEN h % 101 IN (3, 4, 5) THEN NULL WHEN h % 103 = 1 THEN '  '
       ELSE CAST(l_orderkey*10 + l_linenumber AS VARCHAR(20)) END AS serial_no,
  CASE WHEN h % 101 IN (4, 5) THEN NULL ELSE concat(' V', CAST(l_linenumber AS VARCHAR(2)), ' ') END AS vehicle,
  CASE WHEN h % 101 IN (4, 5) THEN NULL WHEN h % 107 = 1 THEN 'not-a-date' WHEN h % 107 = 2 THEN '31-02-1999'
       WHEN h % 3 = 0 THEN iso WHEN h % 3 = 1 THEN replace(day_first, '-', '/') ELSE day_first END AS date,
  CASE WHEN h % 101 IN (4, 5) THEN NULL WHEN h % 109 = 1 THEN 'Night' WHEN l_linenumber % 4 = 0 THEN ' evening '
       WHEN l_linenumber % 2 = 0 THEN 'E' WHEN l_linenumber % 3 = 0 THEN 'm' ELSE 'Morning' END AS shift,
  CASE WHEN h % 101 IN (4, 5) THEN NULL WHEN h % 127 = 1 THEN '' ELSE CAST(l_suppkey AS VARCHAR(20)) END AS dcs,
  CASE WHEN h % 101 = 4 THEN NULL WHEN h % 101 = 5 THEN ' Total ' WHEN h % 113 = 1 THEN ' '
       WHEN h % 131 = 1 THEN 'TOTAL' ELSE concat('  ', s_name, ' ') END AS society_name,
  CASE WHEN h % 101 = 4 THEN NULL WHEN h % 97 = 1 THEN 'not-a-number' WHEN h % 97 = 2 THEN '1,000'
       ELSE CAST(CAST(60 + l_quantity AS INT) AS VARCHAR(10)) END AS qty,
  CASE WHEN h % 101 IN (4, 5) THEN NULL WHEN h % 89 = 1 THEN 'inf' WHEN h % 89 = 2 THEN '1e1'
       ELSE concat(CAST(4 + CAST(round(l_tax*100) AS INT) % 3 AS VARCHAR(2)), '.5') END AS fat_pct,
  CASE WHEN h % 101 IN (4, 5) THEN NULL WHEN h % 83 = 1 THEN 'nan' WHEN h % 83 = 2 THEN ' .5 '
       ELSE concat('8.', CAST(CAST(round(l_discount*100) AS INT) AS VARCHAR(2))) END AS snf_pct,
  CASE WHEN h % 101 IN (4, 5) THEN NULL WHEN h % 79 = 1 THEN NULL ELSE '28' END AS clr,
  CASE WHEN h % 101 IN (4, 5) THEN NULL ELSE '5.1' END AS kg_fat,
  CASE WHEN h % 101 IN (4, 5) THEN NULL ELSE 'bad' END AS kg_snf,
  CASE WHEN h % 101 IN (4, 5) THEN NULL ELSE '40' END AS rate,
  CAST(NULL AS VARCHAR(10)) AS amount
FROM t
"""

# One header per report file: layout A, layout B in another order with extra columns, or a layout nobody knows.
HEADERS_SQL = """
WITH f AS (SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 'FacilityA' ELSE 'FacilityB' END AS facility,
                  CAST(year(l_shipdate) AS INT) AS y, CAST(month(l_shipdate) AS INT) AS m FROM lineitem)
SELECT facility, y AS file_year, m AS file_month,
  CASE WHEN m % 5 = 0 THEN 'Serial|Date|Shift|Qty'
       WHEN facility = 'FacilityA' THEN
         ' S.NO. |VCH.|DATE|SHIFT.|DCS|SOCIETY NAME|QTY|Fat %|Snf %|CLR|Kg, Fat|Kg. Snf|Rate|Amount'
       ELSE 'Data|Society Name|Qty|Fat %|Snf %|Clr|Sl No|Date |Shift|DCS No.' END AS header_text
FROM f
"""


def load(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for table in tables:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        # A file of one row group is one task. Where the scan is narrower than the machine, spread its rows;
        # a scan of many files or row groups is left as it is.
        cores = spark.sparkContext.defaultParallelism
        if table == "lineitem" and rows.rdd.getNumPartitions() < cores:
            rows = rows.repartition(cores)
        rows.createOrReplaceTempView(table)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "lineitem", "supplier")
    return spark.sql(RECORDS_SQL)


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "lineitem", "supplier")
    return spark.sql(RAW_ROWS_SQL)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "lineitem")
    return spark.sql(HEADERS_SQL)


def written_reports(spark: SparkSession, sf_dir: str, folder: str, kind: str = "csv") -> None:
    """The raw rows as report files below ``folder``: FacilityA's in layout A, FacilityB's in layout B, rows by source_row.

    Spark writes one folder per file; each is then given its report's name.
    """
    rows = raw_rows(spark, sf_dir)
    for facility, layout in (("FacilityA", LAYOUT_A), ("FacilityB", LAYOUT_B)):
        own = rows.where(F.col("facility") == facility).repartition("source_file").sortWithinPartitions("source_file", "source_row", *LAYOUT_A.values())
        cells = list(layout.items()) if facility == "FacilityA" else list(layout.items())[::-1]
        named = own.select("source_file", *[F.col(dst).alias(src) for src, dst in cells])
        out = named.write.partitionBy("source_file")
        if kind == "csv":
            out.csv(f"{folder}/{facility}", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        else:
            out.parquet(f"{folder}/{facility}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in files.globStatus(path(f"{folder}/*/source_file=*/part-*")):
        own = part.getPath().getParent()
        name = unquote(own.getName().split("=", 1)[1])
        files.rename(part.getPath(), path(own.getParent(), name.removesuffix(".csv") + f".{kind}"))
        files.delete(own, True)
