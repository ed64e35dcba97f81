"""Best-fit packing of documents into token sequences, online and with a bounded number of open bins.

Every task reads its documents as they come and keeps at most ``OPEN_BINS`` open sequences. They are found by
their free space: bit f of one integer is set while a sequence with f free tokens is open. The best fit of a piece
of n tokens is the lowest set bit from n on. A full sequence closes at once; when a new one is needed and
``OPEN_BINS`` are open, the fullest (lowest set bit) closes first.

What a task leaves open is not written as such: the pieces of those sequences (at most OPEN_BINS a task) are packed
once more, ``TASKS_JOINED`` tasks together, so that splitting the input costs next to nothing. A document of more
than ``CAPACITY`` tokens is cut into pieces of CAPACITY tokens, counted from its end, so that only its first piece
can be shorter; no other document is cut.

Nothing is shuffled but the descriptions of the pieces left open. Memory of a task: one batch of texts, the ids of
one batch, the descriptions of the open pieces (at most OPEN_BINS x CAPACITY). Sequence ids are the number of the
task that closed a sequence and its count there, so a task that is run again gives the same rows.

Cases: null or empty text: one piece, the end id alone. Rows that share a doc_id, or have none, are documents of
their own. Empty table: empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curdline.llm.tokens import encoder, text_list
from curdline.llm.words import in_small_batches, sliced
from curdline.sources.tables import materialized

CAPACITY = 1024
OPEN_BINS = 256
TASKS_JOINED = 64

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
_NAMES = [part.split()[0] for part in PIECES.split(", ")]
_STAGED = PIECES + ", is_open boolean, task int"


class OpenBins:
    """The open sequences, by free space; gives back the contents of those that close."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most, self.count = capacity, most, 0
        self.free_bits = 0
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.free_bits ^= 1 << free
        self.count -= 1
        return found

    def _put(self, free: int, content: list) -> None:
        self.by_free[free].append(content)
        self.free_bits |= 1 << free
        self.count += 1

    def add(self, length: int, item) -> Iterator[list]:
        """Place an item; yields every sequence that this closes."""
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            content = self._take(free)
        else:
            if self.count >= self.most:
                yield self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, content = self.capacity, []
        content.append(item)
        if free == length:
            yield content
        else:
            self._put(free - length, content)

    def rest(self) -> Iterator[list]:
        while self.free_bits:
            yield self._take((self.free_bits & -self.free_bits).bit_length() - 1)


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def _rows(sequence: int, content: list, is_open: bool, task: int) -> Iterator[tuple]:
    offset = 0
    for doc_id, piece, start, length, crc in content:
        yield doc_id, piece, start, length, crc, sequence, offset, is_open, task
        offset += length


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("is_open", pa.bool_()),
    ("task", pa.int32()),
])


def _pack(items: Iterator[tuple], first_id: int, task: int, keep_open: bool) -> Iterator[pa.RecordBatch]:
    bins, closed, rows = OpenBins(CAPACITY, OPEN_BINS), 0, []
    for item in items:
        for content in bins.add(item[3], item):
            rows += _rows(first_id + closed, content, False, task)
            closed += 1
        if len(rows) >= 5_000:
            yield _batch(rows, _ARROW)
            rows = []
    for content in bins.rest():
        rows += _rows(first_id + closed, content, keep_open, task)
        closed += 1
    yield _batch(rows, _ARROW)


def _first_id(task: int, level: int) -> int:
    return (2 * task + level) << 32


def _text_packer(spec: Callable[[], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode = encoder(spec()).encode
        for batch in sliced(batches, "text"):
            for doc_id, ids in zip(
                batch.column("doc_id").to_pylist(), encode(text_list(batch.column("text"))), strict=True
            ):
                for piece, (start, length) in enumerate(cut_points(len(ids) // 4, CAPACITY)):
                    yield doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        yield from _pack(items(batches), _first_id(task, 0), task, keep_open=True)

    return run


def _repack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def items() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in _NAMES[:5]), strict=True)

    task = TaskContext.get().partitionId()
    yield from _pack(items(), _first_id(task, 1), task, keep_open=False)


def packed(documents: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: where its ids lie in its document and in which sequence, with the CRC-32 of the ids.

    ``tokenizer`` is the text of a tokenizer file (see :func:`curdline.llm.tokens.tokenizer_spec`).
    """
    shipped = documents.sparkSession.sparkContext.broadcast(tokenizer)
    texts = in_small_batches(documents).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    staged = materialized(texts.mapInArrow(_text_packer(lambda: shipped.value), _STAGED), "packed")
    left = staged.filter("is_open").withColumn("joined", F.floor(F.col("task") / TASKS_JOINED))
    groups = left.repartition(F.col("joined")).sortWithinPartitions("joined", F.desc("length"), "sequence_id", "offset")
    again = groups.select(*_NAMES, "is_open", "task").mapInArrow(_repack, _STAGED)
    return staged.filter("NOT is_open").union(again).select(*_NAMES)


def sequence_ids(documents: DataFrame, pieces: DataFrame, tokenizer: str) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of int), doc_ids in their order.

    Texts are joined with their pieces by document, encoded where they meet, and gathered by sequence, each of at
    most CAPACITY tokens. It needs documents with distinct ids.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(tokenizer)
    wanted = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("_p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shipped.value).encode
        for batch in sliced(batches, "text"):
            rows = []
            for doc_id, ids, parts in zip(
                batch.column("doc_id").to_pylist(), encode(text_list(batch.column("text"))),
                batch.column("_p").to_pylist(), strict=True,
            ):
                whole = np.frombuffer(ids, "<u4").astype(np.int32)
                rows += [(p["sequence_id"], p["offset"], doc_id, whole[p["start"] : p["start"] + p["length"]]) for p in parts]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int32())),
            ], names=["sequence_id", "offset", "doc_id", "ids"])

    parts = in_small_batches(documents).select("doc_id", "text").join(wanted, "doc_id").mapInArrow(
        run, "sequence_id bigint, offset bigint, doc_id bigint, ids array<int>"
    )
    ordered = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return ordered.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
