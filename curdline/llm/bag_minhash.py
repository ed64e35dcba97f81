"""BagMinHash signatures of the word shingles of texts, as numpy work on Arrow batches.

A text is a bag: its shingles of ``SHINGLE`` words with their counts as weights. For every shingle there are Poisson
processes over the discretised weights 1, 2, 3, ...: one on each interval (0, 1], (1, 2], (2, 4], (4, 8], ... of
rate equal to the interval's length. A point of a process has a time, a unit cell inside its interval and one of
the ``SIGNATURE`` places, all fixed by the shingle, the interval and the point's number. A shingle of weight w uses
the intervals below w whole and of the one that holds w the points in cells up to w. The signature keeps for each
place the first point. Two texts agree in a place with the probability of their weighted Jaccard likeness
(sum of least weights / sum of greatest weights), without bias.

Points come in order of time, so all later ones of a process can be left aside once every place has an earlier
point: a text of n shingles takes about n + SIGNATURE x log(SIGNATURE) points, not n x SIGNATURE.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from curdline.llm.words import PLAIN, mixed, words_of

SHINGLE = 5
BANDS = 25
ROWS = 5
SIGNATURE = BANDS * ROWS

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 2.0**-53


@dataclass
class Bags:
    """Distinct shingles of some texts with their weights, ordered by row."""

    rows: int
    row: np.ndarray
    shingle: np.ndarray
    weight: np.ndarray

    def bounds(self) -> np.ndarray:
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def bags_of(texts: pa.Array) -> Bags:
    """The bags of a text column. A text of fewer words than a shingle is one shingle; one without words has none."""
    words = words_of(texts, PLAIN)
    at, hashes = words.runs(SHINGLE)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    row = np.concatenate([np.searchsorted(words.first, at, "right") - 1, short])
    hashes = np.concatenate([hashes, words.range_hashes(words.first[short], words.first[short + 1])])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    start = np.flatnonzero(new)
    return Bags(len(texts), row[start], hashes[start], np.diff(np.append(start, len(row))))


def _processes(bags: Bags) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, seed, length of the interval, cells of it that count) of all processes of all shingles."""
    levels = np.ceil(np.log2(bags.weight)).astype(np.int64) + 1  # weight 1: one interval, 2: two, 3 and 4: three
    which = np.repeat(np.arange(len(bags.row)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    high = 1 << level
    seed = mixed(bags.shingle[which] + level.astype(np.uint64) * _GOLDEN)
    return bags.row[which], seed, high - low, np.minimum(bags.weight[which], high) - low


def signatures(bags: Bags) -> np.ndarray:
    """rows x SIGNATURE times of first points; infinite for a text without shingles."""
    result = np.full(bags.rows * SIGNATURE, np.inf)
    row, seed, length, cells = _processes(bags)
    total = np.bincount(bags.row, bags.weight, minlength=bags.rows)
    # by this time a place is still free with probability exp(-9) / SIGNATURE; rows with a free place go on
    limit = np.where(total > 0, SIGNATURE * (np.log(SIGNATURE) + 9.0) / np.maximum(total, 1), 0.0) / SIGNATURE
    time = np.zeros(len(row))
    number = np.zeros(len(row), np.uint64)
    active = np.arange(len(row))
    while len(active):
        base = seed[active] + number[active] * _GOLDEN
        drawn = mixed(base)
        step = -np.log1p(-(drawn >> np.uint64(11)).astype(float) * _UNIT) / length[active]
        arrival = time[active] + step
        early = arrival <= limit[row[active]]
        hit, arrival, more = active[early], arrival[early], mixed(base[early] ^ _GOLDEN)
        place = (more & np.uint64(0xFFFFFFFF)).astype(np.int64) % SIGNATURE
        cell = ((more >> np.uint64(32)).astype(float) * 2.0**-32 * length[hit]).astype(np.int64)
        counted = cell < cells[hit]
        np.minimum.at(result, row[hit[counted]] * SIGNATURE + place[counted], arrival[counted])
        time[hit] = arrival
        number[hit] += np.uint64(1)
        active = hit
        if not len(active):
            free = np.isinf(result.reshape(bags.rows, SIGNATURE)).any(axis=1) & (total > 0)
            if free.any():
                limit[free] *= 2
                # their processes go on where they stopped: the point that came too late was not used up
                active = np.flatnonzero(free[row])
    return result.reshape(bags.rows, SIGNATURE)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """rows x BANDS hashes of ROWS places each, different for each band."""
    keys = np.zeros((len(signature), BANDS), np.uint64)
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), BANDS, ROWS)
    keys += np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys * _GOLDEN + bits[:, :, r])
    return keys


def bag_keys(bags: Bags) -> np.ndarray:
    """One hash for each bag, whatever the order of its shingles; 0 for a text without words."""
    values = mixed(bags.shingle ^ mixed(bags.weight.astype(np.uint64)))
    bounds = bags.bounds()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    keys = mixed(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * _GOLDEN)
    keys[bounds[1:] == bounds[:-1]] = 0
    return keys


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags (sorted shingles, weights): what they share by what either has."""
    common, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][at], b[1][bt]).sum()
    return float(shared) / max(1, float(a[1].sum() + b[1].sum() - shared))
