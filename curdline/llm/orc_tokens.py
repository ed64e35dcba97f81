"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are range-partitioned and sorted by doc_id as texts, which are smaller than their ids, and encoded where
they are written. A file holds one range of ids; its stripes are what later readers split it by. ORC itself packs
the ids by integer run-length encoding, keeps the least and greatest doc_id of every stripe and of every
``ROW_INDEX_STRIDE`` rows, and a Bloom filter of doc_id, so that a reader that wants some documents skips the rest
(:func:`documents_with_ids`).

Each row carries its place inside its file's range; the place in the whole corpus is that plus the ids of all
ranges before, one sum for each write task.

Cases: null or empty text: the end id alone. Null doc_id: first, as Spark sorts nulls; its start counts like any
other. Rows with one doc_id stand next to each other, by text. Empty table: empty files, empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curdline.llm.tokens import encoder, text_list
from curdline.llm.words import in_small_batches, sliced

#: Bytes of a stripe and rows between two entries of a row index.
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1_000

OPTIONS = {
    "compression": "zstd", "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(ROW_INDEX_STRIDE),
    "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}
COLUMNS = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>"


def _encoded(spec: Callable[[], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(spec()).encode
        part, before = TaskContext.get().partitionId(), 0
        for batch in sliced(batches, "text"):
            ids = encode(text_list(batch.column("text")))
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(before + ends - counts),
                pa.array(counts),
                pa.ListArray.from_arrays(
                    pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4"))
                ),
            ], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
            before += int(ends[-1])

    return run


def write(documents: DataFrame, tokenizer: str, path: str) -> None:
    """Write the ids of all documents below ``path``, in ascending doc_id order over files and inside each."""
    shipped = documents.sparkSession.sparkContext.broadcast(tokenizer)
    texts = in_small_batches(documents).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encoded(lambda: shipped.value), COLUMNS).write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids: whole files, split by stripes."""
    rows = spark.read.schema(COLUMNS).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select(
        "part",
        F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    # one row for each task that wrote, however many documents there are
    placed = rows.join(F.broadcast(before), "part")
    return placed.select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def documents_with_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents; the filter reaches the files, whose indexes and Bloom filters rule stripes out."""
    return spark.read.schema(COLUMNS).orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py() if len(ids) else np.zeros(1, np.int32)
        raw = memoryview(ids.flatten().to_numpy().astype("<u4", copy=False).tobytes())
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def checksums(stored: DataFrame) -> DataFrame:
    """doc_id, start, number and CRC-32 of the ids that :func:`read` gives."""
    return in_small_batches(stored).select("doc_id", "start", "ids").mapInArrow(
        _checked, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
