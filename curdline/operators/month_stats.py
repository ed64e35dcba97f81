"""Society-month statistics (A2-A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curdline.functions.expressions import finite
from curdline.operators.group_summary import HOT_ROWS, summarize_groups
from curdline.schema import LIMITS, METRICS, MONTH_KEYS, MONTH_STATS


def clean_measures(records: DataFrame) -> DataFrame:
    return records.withColumns({m: finite(F.col(m)) for m in METRICS})


def month_stats(
    records: DataFrame,
    filename: Column | None = None,
    parser_warnings: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per society and month, in the column order of ``schema.MONTH_STATS``."""
    counts = {
        "record_count": F.lit(True),
        "morning_count": F.col("shift") == "M",
        "evening_count": F.col("shift") == "E",
        "low_qty_count": F.col("qty") < LIMITS.low_qty,
    }
    rows = clean_measures(records).withColumn("filename", filename if filename is not None else F.lit(""))
    stats = summarize_groups(rows, MONTH_KEYS, counts, ["season", "filename"], hot_rows)
    stats = stats.withColumns({
        "high_snf_spike_count": F.col("snf_above_p90"),
        "processed_at": F.current_timestamp(),
        "parser_warning_count": F.lit(parser_warnings).cast("bigint"),
    })
    return stats.select(*MONTH_STATS.names)
