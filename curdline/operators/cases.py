"""Review cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curdline.functions.expressions import plain_number, printed_date, priority_rank
from curdline.operators.merge import distinct_by, keyed_merge
from curdline.schema import CASE_STATUSES, NEXT_STEP, REVIEW_CASE
from curdline.sources.tables import materialized


def review_cases(report: DataFrame) -> DataFrame:
    """One OPEN case per source record and category; the id is a hash of the record's identity.

    What is the same in all cases is added after the duplicates are out, so that their sort does not carry it.
    """
    identity = [
        F.col("facility"), F.col("serial_no").cast("string"), plain_number(F.col("dcs")),
        printed_date(F.col("date")), F.col("shift"), F.col("file_year").cast("string"),
        F.col("file_month").cast("string"), F.col("diagnosis"),
    ]
    text = F.concat_ws("|", *[F.coalesce(part, F.lit("")) for part in identity])
    cases = report.select(
        F.substring(F.sha2(text, 256), 1, 20).alias("case_id"),
        "facility", F.col("dcs").cast("double").alias("dcs"), "society_name",
        F.col("file_year").cast("int").alias("file_year"), F.col("file_month").cast("int").alias("file_month"),
        "date", "shift", F.col("diagnosis").alias("screening_category"), F.col("confidence").alias("priority"),
    )
    order = [priority_rank(F.col("priority")), F.col("society_name")]
    return distinct_by(cases, ["case_id"], order).withColumns({
        "screening_date": printed_date(F.col("date")), "status": F.lit("OPEN"), "recommended_next_step": F.lit(NEXT_STEP),
        "disposition": F.lit(None).cast("string"), "confirmation_reference": F.lit(None).cast("string"),
    }).select(*REVIEW_CASE.names)


def merge_cases(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New cases are added; a known case keeps its human edits."""
    return keyed_merge(existing, new, ["case_id"], preserve_existing=True)


def list_cases(cases: DataFrame, status: str | None = None) -> DataFrame:
    chosen = cases if status is None else cases.where(F.col("status") == status)
    return chosen.orderBy(
        F.desc("file_year"), F.desc("file_month"), priority_rank(F.col("priority")), F.col("case_id")
    )


def numbered(listed: DataFrame, name: str = "place") -> DataFrame:
    """An ordered frame with the place of each row, from 1, without bringing the rows to one task.

    The sort leaves the rows in ranges, one for each partition. Rows are numbered inside their range and stored; the
    sizes of the ranges, one number for each partition, are summed up and added. Empty frame: no row.
    """
    within = (1 << 33) - 1  # Spark's row ids: the partition above 33 bits, the place in it below
    ranges = materialized(listed.withColumn(name, F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(F.col(name), 33)
    before, total = [], 0
    for r in ranges.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).orderBy("part").collect():
        before.append((r["part"], total + 1))
        total += r["rows"]
    starts = F.create_map(*[F.lit(x).cast("bigint") for pair in before for x in pair]) if before else F.lit(None).cast("map<bigint,bigint>")
    return ranges.withColumn(name, F.element_at(starts, part) + F.col(name).bitwiseAND(F.lit(within)))


def case_page(cases: DataFrame, first: int, last: int, status: str | None = None) -> DataFrame:
    """The cases at places ``first`` to ``last`` of the listing."""
    return numbered(list_cases(cases, status)).where(F.col("place").between(first, last))


def apply_dispositions(cases: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply (case_id, status, disposition, confirmation_reference) updates.

    The status is always replaced; the other two only when given.
    """
    given = updates.select(
        "case_id", F.upper("status").alias("new_status"), F.col("disposition").alias("new_disposition"),
        F.col("confirmation_reference").alias("new_reference"),
    )
    return cases.join(given, "case_id", "left").withColumns({
        "status": F.coalesce("new_status", "status"),
        "disposition": F.coalesce("new_disposition", "disposition"),
        "confirmation_reference": F.coalesce("new_reference", "confirmation_reference"),
    }).select(*cases.columns)


def refused_updates(cases: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates that cannot be applied, with the reason."""
    known = F.upper("status").isin(CASE_STATUSES)
    unsupported = updates.where(~F.coalesce(known, F.lit(False))).withColumn("reason", F.lit("unsupported status"))
    unknown = updates.join(cases.select("case_id"), "case_id", "left_anti").withColumn(
        "reason", F.lit("unknown case_id")
    )
    twice = updates.groupBy("case_id").count().where(F.col("count") > 1).select("case_id")
    repeated = updates.join(twice, "case_id", "left_semi").withColumn("reason", F.lit("repeated case_id"))
    return unsupported.unionByName(unknown).unionByName(repeated)


def checked_dispositions(cases: DataFrame, updates: DataFrame) -> DataFrame:
    """The same as ``apply_dispositions``, but an error if any update is refused."""
    refused = refused_updates(cases, updates).limit(5).collect()
    if refused:
        named = "; ".join(f"{r['case_id']}: {r['reason']} ({r['status']})" for r in refused)
        raise ValueError(f"Cannot apply case updates: {named}. Statuses: {', '.join(CASE_STATUSES)}")
    return apply_dispositions(cases, updates)
