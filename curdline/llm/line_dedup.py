"""Repeated lines, found through a levelled store of sorted runs of line hashes.

A document's line is known by its key: the line without ASCII white space at both ends, A-Z lower-cased. Keys of at
least ``MIN_CHARS`` code points enter the store as a 128-bit hash, with the number of documents that hold the key and
the largest doc_id among them (:class:`LineRuns`).

Documents come in batches. A batch's keys are aggregated, merge-anti-joined with the stored runs, which leaves the keys
that no run holds, and merge-joined with them for the totals of the others; both are written as one new run of level
0: running totals, so the newest entry of a key stands for all older ones. ``FANOUT`` runs of a level are compacted
into one of the next level, so there are at most FANOUT times the logarithm of the number of batches. Runs are tables
bucketed and sorted by hash: joins with them shuffle the batch alone. A run is whole before the manifest names it; a
store opened again has what the manifest names (:meth:`LineRuns.opened`).

When all batches are in, every batch is merge-anti-joined with the runs once more: a line stays unless its key is
held by ``MIN_DOCUMENTS`` documents and a larger doc_id (:func:`judged`). A key that a large share of all documents
hold is one row of the store; for the join that fans out again to documents such keys are broadcast. They are those
held by over a ``HOT_KEYS``-th of all (key, document) pairs, so at most HOT_KEYS rows.

Cases: null or empty text: one empty line, which is too short to be a key. Rows that share a doc_id are one document
for counting, and each keeps or loses its own lines; null doc_ids are one document, below all others. A document
repeats a line: all its copies go or all stay. Empty table: empty result. Other columns are kept, whatever their
names. A document that is handed to a store twice, in two batches, counts twice: batches must not overlap.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from curdline.llm.words import in_small_batches, sliced
from curdline.sources.tables import materialized, shared_folder

MIN_CHARS = 20
MIN_DOCUMENTS = 3
#: Runs of one level that are compacted into one of the next.
FANOUT = 3
#: Batches that a whole table is dealt into.
BATCHES = 6
#: Bound for the keys that are broadcast.
HOT_KEYS = 10_000

KEY = ["h", "g"]  # the two halves of a key's hash
_PAIRS = "doc_id bigint, copy bigint, h bigint, g bigint"
_RUN = "h bigint, g bigint, docs bigint, last bigint"
#: A row's document and, as rows may share a doc_id, its text. A null doc_id is the smallest of all.
_NAMED = [f"coalesce(CAST(doc_id AS BIGINT), {1 - (1 << 63)} - 1) AS doc_id", "xxhash64(text) AS copy"]


def keys_of(text: bytes | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """Of each line its key's 16-byte hash; None where the key is too short."""
    found: list[bytes | None] = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(b"\x20\t\n\x0b\x0c\r").lower()  # bytes: A-Z only
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        found.append(xxhash.xxh3_128_digest(key) if long else None)
    return found


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _halves(keys: list[bytes]) -> tuple[pa.Array, pa.Array]:
    pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return pa.array(pairs[:, 0]), pa.array(pairs[:, 1])


def line_keys(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, copy, h, g): the distinct keys of each row's lines; ``copy`` is a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            keys, owners = [], []
            for i, text in enumerate(_texts(batch)):
                own = set(keys_of(text, min_chars)) - {None}
                keys += own
                owners += [i] * len(own)
            h, g = _halves(keys)
            of = batch.select(["doc_id", "copy"]).take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays([*of.columns, h, g], names=["doc_id", "copy", *KEY])

    return in_small_batches(documents.selectExpr(*_NAMED, "text")).mapInArrow(run, _PAIRS)


class LineRuns:
    """A levelled store of sorted runs: per key the number of documents that hold it and the largest doc_id."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []  # (level, name), oldest first
        self.version = -1

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> LineRuns:
        """The store as its newest manifest names it."""
        rows = spark.read.schema("version bigint, state string").json(f"{path.rstrip('/')}/manifests")
        newest = rows.orderBy(F.desc("version")).first()
        state = json.loads(newest["state"])
        store = cls(spark, path, state["buckets"], state["fanout"])
        store.version = newest["version"]
        store.runs = [(level, name) for level, name in state["runs"]]
        for _, name in store.runs:
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({_RUN}) USING parquet OPTIONS (path '{store.path}/{name}') "
                f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {store.buckets} BUCKETS"
            )
        return store

    def _write(self, rows: DataFrame) -> str:
        """Rows that are already dealt to the buckets, as one file each."""
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _commit(self, runs: list[tuple[int, str]]) -> None:
        state = json.dumps({"buckets": self.buckets, "fanout": self.fanout, "runs": runs})
        row = self.spark.createDataFrame([(self.version + 1, state)], "version bigint, state string")
        row.coalesce(1).write.mode("append").json(f"{self.path}/manifests")
        self.runs, self.version = runs, self.version + 1

    def _merged(self, runs: list[tuple[int, str]]) -> DataFrame:
        """The newest entry of every key: it has the largest count, as totals only grow."""
        rows = self.spark.createDataFrame([], _RUN)
        for _, name in runs:
            rows = rows.union(self.spark.table(name))
        dealt = rows.repartition(self.buckets, *KEY)
        return dealt.groupBy(*KEY).agg(F.max("docs").alias("docs"), F.max("last").alias("last"))

    def entries(self) -> DataFrame:
        """(h, g, docs, last) of every key."""
        return self._merged(self.runs)

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows whose key (h, g) no run holds: one merge-anti-join for each run, which shuffles ``keys`` once."""
        for _, name in self.runs:
            keys = keys.join(self.spark.table(name).hint("merge"), KEY, "left_anti")
        return keys

    def totals(self, own: DataFrame) -> DataFrame:
        """The entries of a batch (h, g, docs, last) with what the runs hold of their keys added."""
        docs, last = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
        rows = own
        for i, (_, name) in enumerate(self.runs):
            rows = rows.join(self.spark.table(name).toDF(*KEY, f"docs_{i}", f"last_{i}").hint("merge"), KEY, "left")
            docs, last = F.greatest(docs, f"docs_{i}"), F.greatest(last, f"last_{i}")  # null where no run holds it
        return rows.select(*KEY, (F.col("docs") + docs).alias("docs"), F.greatest("last", last).alias("last"))

    def add(self, pairs: DataFrame) -> None:
        """Merge the (doc_id, h, g) of a batch of documents into the store as a new run."""
        own = materialized(
            pairs.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one")).groupBy(*KEY)
            .agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")), "batch_keys"
        )
        dealt = own.repartition(self.buckets, *KEY)
        runs = [*self.runs, (0, self._write(self.totals(dealt)))]
        while True:  # compaction: a full level becomes one run of the next
            level = runs[-1][0]
            full = [r for r in runs if r[0] == level]
            if len(full) < self.fanout:
                break
            runs = [*(r for r in runs if r[0] != level), (level + 1, self._write(self._merged(full)))]
        self._commit(runs)


def stored(documents: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> tuple[LineRuns, DataFrame]:
    """A store of all documents' lines, filled batch by batch, and their keys.

    A batch holds the documents of one residue of a hash of doc_id, so no document is in two.
    """
    spark = documents.sparkSession
    dealt = line_keys(documents, min_chars).withColumn("batch", F.expr(f"CAST(pmod(xxhash64(doc_id), {batches}) AS INT)"))
    path = f"{shared_folder(spark)}/curdline/{uuid.uuid4().hex}"
    dealt.write.partitionBy("batch").parquet(f"{path}/line_keys")
    pairs = spark.read.schema(f"{_PAIRS}, batch int").parquet(f"{path}/line_keys")
    store = LineRuns(spark, f"{path}/runs")
    for batch in range(batches):
        store.add(pairs.where(F.col("batch") == batch).select("doc_id", *KEY))
    return store, pairs.drop("batch")


def judged(pairs: DataFrame, store: LineRuns, min_documents: int = MIN_DOCUMENTS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(doc_id, copy, drops): the hashes of the keys whose lines a row loses; rows that lose none are left out."""
    repeated = materialized(store.entries().where(F.col("docs") >= min_documents), "repeated_lines")
    total = repeated.agg(F.sum("docs")).first()[0] or 0
    hot = repeated.where(F.col("docs") * hot_keys > total)  # fewer than hot_keys, as their counts are parts of total
    rest = repeated.where(F.col("docs") * hot_keys <= total)
    met = pairs.join(F.broadcast(hot), KEY, "left")
    others = met.where("docs IS NULL").select("doc_id", "copy", *KEY).join(rest, KEY)
    columns = ["doc_id", "copy", *KEY, "last"]
    lost = met.where("docs IS NOT NULL").select(*columns).union(others.select(*columns)).where("doc_id < last")
    return lost.groupBy("doc_id", "copy").agg(F.collect_set(F.struct(*KEY)).alias("drops"))


def _lines(batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[int, list[bytes], bytes | None]]:
    """Of each row the number of its lines, those that stay, and its text."""
    for text, lost in zip(_texts(batch), batch.column("drops"), strict=True):
        lines = (text or b"").split(b"\n")
        kept = lines
        if lost.is_valid:
            halves = np.array([(d["h"], d["g"]) for d in lost.as_py()], "<i8")
            gone = {pair.tobytes() for pair in halves}
            kept = [line for line, key in zip(lines, keys_of(text, min_chars), strict=True) if key not in gone]
        yield len(lines), kept, text


def _with_drops(documents: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """Of each row its text, its other columns as one struct ``rest``, and its drops."""
    store, pairs = stored(documents, batches, min_chars)
    others = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    rows = documents.select(*map(F.expr, _NAMED), "text", F.struct(*others).alias("rest"))
    found = rows.join(judged(pairs, store), ["doc_id", "copy"], "left")
    return in_small_batches(found.select("text", "rest", "drops"))


def deduplicated(documents: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents, all columns kept, without the lines that go; a text of which no line goes stays as it is."""
    schema = documents.schema
    place = schema.names.index("text")

    def run(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(record_batches, "text"):
            texts = [
                None if text is None else text.decode() if len(kept) == n else b"\n".join(kept).decode()
                for n, kept, text in _lines(batch, min_chars)
            ]
            columns = batch.column("rest").flatten()
            columns.insert(place, pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).cast(to_arrow_schema(schema))

    return _with_drops(documents, batches, min_chars).mapInArrow(run, schema)


def digests(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept lines joined by line breaks."""

    def run(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(record_batches, "text"):
            counts, dropped, hashes = [], [], []
            for n, kept, _ in _lines(batch, MIN_CHARS):
                counts.append(n)
                dropped.append(n - len(kept))
                hashes.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rest").field("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(hashes)],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _with_drops(texts, batches, MIN_CHARS).mapInArrow(
        run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"
    )
