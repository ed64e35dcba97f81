"""Words of Arrow text columns as numpy arrays: positions, 64-bit hashes, hashes of word runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: A slice of a batch holds about so many bytes of text, or one longer text, so that its arrays stay small.
SLICE_BYTES = 1 << 19
#: Rows of an Arrow batch. Texts may be long; the default of 10,000 rows would hold hundreds of megabytes of them.
BATCH_ROWS = 500

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_SEED = np.random.Generator(np.random.PCG64(20_240_601))
_BYTE_VALUES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits, so that every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were ever asked for."""

    def __init__(self, base: int) -> None:
        self.bases = (base, pow(base, -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, 2 * len(self.tables[0]))
            self.tables = [
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                for b in self.bases
            ]
        return self.tables


_BYTE_POWERS, _WORD_POWERS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A hash of values[start:end] for each range, by polynomial prefix sums; equal ranges have equal hashes."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of values[start:end] for each range, the values being hashes themselves."""
    return _range_hashes(values, starts, ends, _WORD_POWERS)


def _byte_class(of_word, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    is_word = np.array([of_word(b) for b in range(256)])
    values = _BYTE_VALUES.copy()
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    values[~is_word] = 0
    return is_word, values


#: Runs of anything but ASCII white space, unchanged.
RAW = _byte_class(lambda b: b not in b"\x20\x09\x0a\x0b\x0c\x0d", lower=False)
#: Runs of ASCII letters and digits and of any non-ASCII characters, ASCII upper and lower case being the same.
PLAIN = _byte_class(lambda b: b >= 0x80 or chr(b).isalnum(), lower=True)


@dataclass
class Words:
    """The words of some consecutive rows; those of row i are ``first[i]`` to ``first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray  # byte positions in data
    ends: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the word sequences from ``starts`` up to, not including, ``ends``."""
        return _range_hashes(self.hashes, starts, ends, _WORD_POWERS)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """All runs of ``k`` words inside one row: the place of the first word and the hash."""
        inside = np.repeat(self.first[1:], self.counts()) - k >= np.arange(len(self.hashes))
        at = np.flatnonzero(inside)
        return at, self.range_hashes(at, at + k)


def words_of(texts: pa.Array, kind: tuple[np.ndarray, np.ndarray] = RAW) -> Words:
    """The words of a text column; a null text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    is_word, values = kind
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)  # a row begins here
    edge[offsets] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    hashes = _range_hashes(values[data], starts, ends, _BYTE_POWERS)
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data)


def sliced(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that the texts of each have at most SLICE_BYTES, or are one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > SLICE_BYTES:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += size
        yield batch.slice(start)


def in_small_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches are sized for texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df
