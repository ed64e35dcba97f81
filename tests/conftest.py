from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]").appName("curdline-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.buffer.pageSize", "2m").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


# a plain delivery of a plain producer: each measure's level and spread, exact in binary
LEVELS = {"qty": (60.0, 8.0), "fat_pct": (4.5, 0.25), "snf_pct": (8.75, 0.125), "clr": (28.25, 0.375)}
PRODUCER = {"facility": "Hillside", "dcs": 7.0, "society_name": "Mill Lane", "season": "summer"}
DELIVERY = {"serial_no": 40, "date": dt.date(2025, 6, 3), "shift": "M", "vehicle": "tank 2", "file_month": 6, "file_year": 2025}
TYPES = {"serial_no": "int", "dcs": "double", "date": "date", "file_month": "int", "file_year": "int", "record_count": "bigint"}


def _maker(spark: SparkSession, plain: dict):
    """A function from partial rows to a frame; what a row leaves out is plain."""
    schema = ", ".join(
        f"{name} {TYPES.get(name) or ('double' if isinstance(value, float) else 'string')}" for name, value in plain.items()
    )

    def frame(rows: list[dict]) -> DataFrame:
        unknown = {name for row in rows for name in row} - set(plain)
        assert not unknown, unknown
        return spark.createDataFrame([[row.get(name, value) for name, value in plain.items()] for row in rows], schema)

    return frame


@pytest.fixture(scope="session")
def records(spark):
    return _maker(spark, PRODUCER | DELIVERY | {m: level for m, (level, _) in LEVELS.items()})


@pytest.fixture(scope="session")
def baselines(spark):
    moments = {f"{m}_{k}": v for m, pair in LEVELS.items() for k, v in zip(("mean", "std"), pair, strict=True)}
    return _maker(spark, PRODUCER | {"record_count": 45} | moments)
