"""Helpers for functions over Arrow batches whose rows Spark has dealt and sorted by a group's keys.

Groups are read from the sorted rows, many at a time; a group that a batch cuts is held until its last row is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts(columns: list[pa.Array]) -> np.ndarray:
    """Places where a group of equal neighbours begins. Nulls are equal to each other, NaNs too, as in Spark."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        null = column.is_null().to_numpy(zero_copy_only=False)
        if pa.types.is_floating(column.type):
            x = column.fill_null(0).to_numpy(zero_copy_only=False)
            differ = (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
        else:
            x = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            differ = x[1:] != x[:-1]
        new[1:] |= differ | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            joined = pa.concat_batches(held)
            last = int(starts([joined.column(k) for k in keys])[-1])
            if last:
                yield joined.slice(0, last)
            held = [joined.slice(last)]
            rows = max(rows, 2 * held[0].num_rows)  # a group of many rows is not looked at for every batch
    if held:
        yield pa.concat_batches(held)


def numbers(column: pa.Array) -> np.ndarray:
    """Doubles, NaN for null."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def ranked(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Texts as places in the sorted list of their distinct values, and this list; null is the place behind its end."""
    coded = column.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)  # by UTF-8 bytes, like Spark
    place = np.empty(len(order) + 1, np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    place[-1] = len(order)
    return place[coded.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)], coded.dictionary.take(order)


def named(places: np.ndarray, values: pa.Array) -> pa.Array:
    """The texts at these places; null where there is none."""
    return values.take(pa.array(places, pa.int64(), mask=places >= len(values)))


def stable(x: np.ndarray) -> np.ndarray:
    """The same as ``expressions.stable_sql``: nine digits, halves away from zero, as the decimal text of the number says.

    Scaling by 1e9 is exact enough unless a number is large or close to a half. A number of ten decimals, as the mean of
    two of nine has, is then rounded by its digits; the few others as decimals.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = x * 1e9
        out = np.rint(scaled) / 1e9 + 0.0
        close = np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-9 + np.abs(scaled) * 1e-15
        digits = np.rint(np.abs(x[close]) * 1e10)
        halves = np.copysign(np.floor((digits + 5) / 10) / 1e9, x[close])
        short = (digits < 1e14) & (digits / 1e10 == np.abs(x[close]))
        out[close] = np.where(short, halves, out[close])
        unsure = (np.abs(scaled) >= 1e13) & np.isfinite(x)
    unsure[np.flatnonzero(close)[~short]] = True
    for i in np.flatnonzero(unsure):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP, _DIGITS))
    return out


#: Enough digits for any double with nine decimals.
_DIGITS = Context(prec=330)


def doubles(x: np.ndarray) -> pa.Array:
    """An Arrow column, null for NaN."""
    return pa.array(x, pa.float64(), mask=np.isnan(x))
