"""Derived tables on shared storage (S5-S9), partitioned by reporting month; versions are committed in one step."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curdline.functions.expressions import finite
from curdline.operators.merge import keyed_merge
from curdline.schema import BATCH

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. A local session, as in tests, may do without one; a cluster may not."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file:{context._jvm.System.getProperty('java.io.tmpdir')}/curdline-{context.applicationId}"


def materialized(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a frame once and read it back: cuts the lineage and survives the loss of executors.

    Wide rows and texts that many tasks read are worth ``zstd``; short-lived columns of hashes are not.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/curdline/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """A stored table, as its newest commit has it or as an earlier ``version`` had it. Never written: empty."""
    return VersionedTable(spark, path, schema).read(version)


def json_ready(df: DataFrame) -> DataFrame:
    """Nested values become JSON text, NaN and infinities null."""

    def encoded(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, _NESTED):
            return F.to_json(column).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return finite(column).alias(field.name)
        return column

    return df.select(*[encoded(f) for f in df.schema])


class ConcurrentCommit(RuntimeError):
    """Another job committed first; the stored table is as that job left it."""


class VersionedTable:
    """A table partitioned by month whose state changes in one step.

    Rows lie below ``data/file_year=/file_month=/batch=``; a batch is the work of one write and never touched again.
    A commit is a small file ``commits/<number>.json`` that lists the batches of each month; the greatest number is
    the table. It is written under another name and renamed, which succeeds once for a number. So a job that dies
    leaves at most batches that no commit names, readers see the old table or the new one, and a reader of an older
    commit keeps its files. A month's entry is one line; the file is a calendar.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.jvm = spark.sparkContext._jvm

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the commits, ascending."""
        if not path_exists(self.spark, f"{self.path}/commits"):
            return []
        names = [f.getPath().getName() for f in self._files().listStatus(self._path("commits"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """Number of a commit and what it holds: ``months`` (the batches of each month) and ``runs`` (see append)."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return 0, {"months": {}, "runs": []}
        if version not in known:
            raise ValueError(f"{self.path} has no version {version}; versions: {known}")
        reader = self.jvm.java.io.BufferedReader(
            self.jvm.java.io.InputStreamReader(self._files().open(self._path("commits", f"{version:010d}.json")), "UTF-8")
        )
        try:
            return version, json.loads("".join(iter(reader.readLine, None)))
        finally:
            reader.close()

    def read(self, version: int | None = None) -> DataFrame:
        months = self.state(version)[1]["months"]
        folders = [f"{self.path}/data/{month}/batch={batch}" for month, batches in months.items() for batch in batches]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)
        return rows.select(*self.schema.names)

    def write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Store rows as a batch of their own, which no reader sees yet: its name and months.

        The rebalance hint lets AQE merge small months into few files and split a month that holds most rows.
        """
        batch = uuid.uuid4().hex
        dealt = rows.select(*self.schema.names).hint("rebalance", *[F.col(c) for c in BATCH]).withColumn("batch", F.lit(batch))
        dealt.write.mode("append").partitionBy(*BATCH, "batch").parquet(f"{self.path}/data", compression="zstd")
        stored = self._files().globStatus(self._path("data", "file_year=*", "file_month=*", f"batch={batch}"))
        months = ["/".join(str(f.getPath()).split("/")[-3:-1]) for f in stored or []]
        return batch, sorted(months)

    def switch(self, version: int, state: dict) -> int:
        """Make ``state`` the table's, if ``version`` is still its newest commit."""
        target = self._path("commits", f"{version + 1:010d}.json")
        draft = self._path("commits", f".{uuid.uuid4().hex}.draft")
        out = self._files().create(draft)
        out.write(bytearray(json.dumps(state, indent=0, sort_keys=True).encode()))
        out.close()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # unlike FileSystem.rename, this never replaces a file
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)
        except Py4JJavaError as problem:
            self._files().delete(draft, False)
            if "FileAlreadyExists" not in problem.java_exception.getClass().getName():
                raise
            raise ConcurrentCommit(f"{self.path}: version {version + 1} was committed by another job") from None
        return version + 1

    def replace(self, rows: DataFrame, touched: list[str], version: int | None = None) -> int:
        """Commit rows as the whole content of the ``touched`` months; a month without rows goes."""
        version, state = self.state(version)
        batch, months = self.write(rows)
        kept = {m: b for m, b in state["months"].items() if m not in touched}
        return self.switch(version, {**state, "months": kept | {m: [batch] for m in months}})

    def append(self, rows: DataFrame, run: str) -> bool:
        """Add rows, once for each ``run``: a repeated append changes nothing. Whether rows were added."""
        version, state = self.state()
        if run in state["runs"]:
            return False
        batch, months = self.write(rows)
        added = {m: [*state["months"].get(m, []), batch] for m in months}
        self.switch(version, {"months": state["months"] | added, "runs": [*state["runs"], run]})
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Remove commits but the newest ``keep``, and batches that none of these names; not while a job writes."""
        files, known = self._files(), self.versions()
        named = {(m, b) for v in known[-keep:] for m, bs in self.state(v)[1]["months"].items() for b in bs}
        gone = 0
        for f in files.globStatus(self._path("data", "file_year=*", "file_month=*", "batch=*")) or []:
            parts = str(f.getPath()).split("/")
            if ("/".join(parts[-3:-1]), parts[-1].removeprefix("batch=")) not in named:
                gone += files.delete(f.getPath(), True)
        for v in known[:-keep]:
            files.delete(self._path("commits", f"{v:010d}.json"), False)
        return gone


def month_folder(row) -> str:
    return "/".join(f"{k}={row[k]}" for k in BATCH)


def upsert(
    spark: SparkSession, path: str, new: DataFrame, keys: list[str], preserve_existing: bool = False,
    months: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Keyed merge into a stored table that rewrites only the months of ``new``; the number of the commit.

    ``months`` names them where the caller knows them, so that ``new`` is computed once. The list is small
    (a calendar) and prunes the partitions of the stored table. ``keep`` cuts the stored rows of these months
    down to those that may stay; a month of which nothing is left goes. The merge reads one commit and is stored
    beside it; if another job commits meanwhile, nothing changes and the caller gets :class:`ConcurrentCommit`.
    """
    table = VersionedTable(spark, path, new.schema)
    version, _ = table.state()
    touched = months if months is not None else new.select(*BATCH).distinct()
    existing = table.read(version or None).join(F.broadcast(touched), BATCH, "left_semi")
    if keep is not None:
        existing = keep(existing)
    merged = keyed_merge(existing, new, keys, preserve_existing).select(*new.columns)
    return table.replace(merged, [month_folder(m) for m in touched.distinct().collect()], version or None)


def append_once(spark: SparkSession, path: str, rows: DataFrame, run: str) -> bool:
    """Append-only table (S7, U5): the rows of a run are added once, however often the job is repeated."""
    return VersionedTable(spark, path, rows.schema).append(rows, run)
