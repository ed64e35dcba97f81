"""Tries as double arrays, built and walked with numpy: all states or positions of a level at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Children from which on a family gets places of its own.
BLOCK = 32


@dataclass
class Trie:
    """Sequences of one length over an alphabet of 64-bit symbols, each symbol's number being spelt in bytes.

    State 0 is the root. The child of state s by byte c is ``base[s] + c + 1`` if ``check`` names s there. An accepting
    state has no children; its ``base`` is the number of its sequence.
    """

    symbols: np.ndarray  # sorted; symbol number c is symbols[c - 1]
    base: np.ndarray
    check: np.ndarray
    length: int  # symbols of a sequence
    width: int  # bytes of a symbol
    sequences: int

    def numbered(self, values: np.ndarray) -> np.ndarray:
        """Symbol numbers of values; 0 for values that are no symbol."""
        if not len(self.symbols):
            return np.zeros(len(values), np.int32)
        at = np.minimum(np.searchsorted(self.symbols, values), len(self.symbols) - 1)
        return np.where(self.symbols[at] == values, at + 1, 0).astype(np.int32)

    def counts(self, values: np.ndarray) -> np.ndarray:
        """How often each sequence occurs in ``values``, overlaps included: every position is walked at once."""
        numbers = self.numbered(values)
        at = np.flatnonzero(numbers[: max(len(numbers) - self.length + 1, 0)])
        state = np.zeros(len(at), np.int32)
        for level in range(self.length):
            number = numbers[at + level]
            alive = number > 0
            at, state, number = at[alive], state[alive], number[alive]
            for shift in range(8 * (self.width - 1), -1, -8):
                following = self.base[state] + ((number >> shift) & 255) + 1
                alive = self.check[following] == state
                at, state, number = at[alive], following[alive], number[alive]
        return np.bincount(self.base[state], minlength=self.sequences)


class _Array:
    """A double array that grows; families of siblings are placed many at a time."""

    def __init__(self, expected: int) -> None:
        self.limit = 257 + expected // 2  # bases lie below; the root's family has 1 to 256
        self.base = np.zeros(self.limit + 257, np.int32)
        self.check = np.full(len(self.base), -1, np.int32)
        self.random = np.random.default_rng(11)

    def _grow(self, limit: int) -> None:
        more = max(limit - self.limit, 0)
        self.limit += more
        self.base = np.append(self.base, np.zeros(more, np.int32))
        self.check = np.append(self.check, np.full(more, -1, np.int32))

    def place(self, parents: np.ndarray, starts: np.ndarray, sizes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Give each parent a base at which all its children fit; the children's states, in the order of ``symbols``.

        Families of ``BLOCK`` children and more get 256 places of their own. Smaller ones fill what is left, the larger
        first, those of like size together: each tries a random base, and those that meet neither a taken place nor
        each other stay. Where few find one the array grows, so all find one in the end.
        """
        states = np.zeros(len(symbols), np.int32)
        group = np.frexp(np.minimum(sizes, BLOCK))[1]
        for g in np.unique(group)[::-1]:
            waiting, low = np.flatnonzero(group == g), 0
            own_block = sizes[waiting[0]] >= BLOCK
            while len(waiting):
                if own_block:  # new places at the end
                    bases = self.limit + 256 * (1 + np.arange(len(waiting)))
                    self._grow(int(bases[-1]) + 256)
                else:
                    bases = self.random.integers(low, self.limit, len(waiting))
                size = sizes[waiting]
                family = np.repeat(np.arange(len(waiting)), size)
                member = np.repeat(starts[waiting], size) + np.arange(len(family)) - np.repeat(np.cumsum(size) - size, size)
                slots = bases[family] + symbols[member]
                bad = np.zeros(len(waiting), bool)
                bad[family[self.check[slots] >= 0]] = True
                order = np.argsort(slots, kind="stable")
                again = np.flatnonzero(slots[order][1:] == slots[order][:-1]) + 1
                bad[family[order[again]]] = True
                fits = ~bad[family]
                self.check[slots[fits]] = parents[waiting][family[fits]]
                states[member[fits]] = slots[fits]
                self.base[parents[waiting[~bad]]] = bases[~bad]
                if bad.sum() > 0.9 * len(bad):  # the next round tries the new places
                    low = self.limit
                    self._grow(self.limit + 256 + 2 * int(size[bad].sum()))
                waiting = waiting[bad]
        return states


def build(sequences: np.ndarray) -> Trie:
    """The trie of the distinct rows of ``sequences``; row i is sequence number i."""
    n, length = sequences.shape
    symbols = np.unique(sequences)
    width = max((len(symbols).bit_length() + 7) // 8, 1)
    numbers = np.searchsorted(symbols, sequences) + 1
    spelt = [(numbers[:, i] >> shift & 255) + 1 for i in range(length) for shift in range(8 * (width - 1), -1, -8)]
    order = np.lexsort(spelt[::-1])
    array = _Array(n)
    changed = np.zeros(n, bool)  # the row's prefix up to the level differs from that of the row before
    changed[:1] = True
    parent_of_row = np.zeros(n, np.int32)
    for level, letters in enumerate(spelt):
        letters = letters[order]
        own = changed.copy()
        own[1:] |= letters[1:] != letters[:-1]
        child_rows = np.flatnonzero(own)
        children = letters[child_rows]
        if level == 0:  # the root's base is 0
            states = children.astype(np.int32)
            array.check[states] = 0
        else:
            starts = np.flatnonzero(changed[child_rows])
            sizes = np.diff(np.append(starts, len(child_rows)))
            states = array.place(parent_of_row[child_rows[starts]], starts, sizes, children)
        parent_of_row = np.repeat(states, np.diff(np.append(child_rows, n)))
        changed = own
    array.base[parent_of_row] = order
    return Trie(symbols, array.base, array.check, length, width, n)
