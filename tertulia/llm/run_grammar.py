"""A run-length grammar of a sequence by recompression, and longest common extensions asked of it.

Rounds alternate: *block compression* names each maximal block of one symbol by (symbol, length); *pair compression*
deals the symbols to two sides and names each neighbouring (left, right) pair.  Both act on symbols
alone, so equal stretches are cut equally but for a few symbols at their ends.  Each round is a level of the grammar: its
symbols and where each begins in the sequence.  Two symbols of a level are equal exactly where the
stretches they stand for are equal, or (different names) differ somewhere.

An extension climbs as long as both places are at borders of the next level, skips whole equal symbols, and comes down
where symbols differ: a few steps a level, many questions at a time.  The cuts only decide the speed; answers are exact.
"""

from __future__ import annotations

import numpy as np

MAX_LEVELS = 96


def _sides(n_symbols: int, level: int) -> np.ndarray:
    """A side for every symbol, by a fixed mixing of its number and the level."""
    x = np.arange(n_symbols, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(40)) & np.uint64(1)).astype(bool)


def _blocks(symbols: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First places of the maximal blocks, their new names, and the number of names."""
    first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    length = np.diff(np.append(first, len(symbols)))
    names = symbols[first].copy()
    long = np.flatnonzero(length > 1)
    if len(long):
        keys = names[long] * (length.max() + 1) + length[long]
        names[long] = n_symbols + np.unique(keys, return_inverse=True)[1]
        n_symbols = int(names.max()) + 1
    return first, names, n_symbols


def _pairs(symbols: np.ndarray, n_symbols: int, level: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The same for neighbouring pairs whose symbols lie on different sides, in the direction with more pairs."""
    right = _sides(n_symbols, level)[symbols]
    up = ~right[:-1] & right[1:]
    down = right[:-1] & ~right[1:]
    head = up if np.count_nonzero(up) >= np.count_nonzero(down) else down
    at = np.flatnonzero(head)
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    names = symbols.copy()
    if len(at):
        names[at] = n_symbols + np.unique(symbols[at] * n_symbols + symbols[at + 1], return_inverse=True)[1]
    return np.flatnonzero(keep), names[keep], n_symbols


class Grammar:
    """Levels of a sequence of numbers: ``starts[h]`` (with the end) and ``symbols[h]``."""

    def __init__(self, sequence: np.ndarray, target: int = 1):
        """Compresses until ``target`` symbols are left, or no round shortens the sequence any more."""
        symbols = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
        starts = np.arange(len(symbols) + 1)
        self.length = len(symbols)
        # blocks[h]: whether level h + 1 was made of level h by block compression.
        self.starts, self.symbols, self.blocks = [starts], [symbols], []
        level = idle = 0
        while len(symbols) > target and level < MAX_LEVELS and idle < 8:
            n_symbols = int(symbols.max()) + 1
            by_blocks = level % 2 == 0
            step = _blocks(symbols, n_symbols) if by_blocks else _pairs(symbols, n_symbols, level)
            level += 1
            if len(step[0]) == len(symbols):
                idle += 1
                continue
            idle = 0
            # Names are made dense again, so that a pair of them fits one number.
            symbols = np.unique(step[1], return_inverse=True)[1].astype(np.int64)
            starts = starts[np.append(step[0], len(starts) - 1)]
            self.starts.append(starts)
            self.symbols.append(symbols)
            self.blocks.append(by_blocks)

    def _index(self, level: int, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The border of a level at or after each spot, and whether it is one at the spot itself."""
        if level == 0:
            return spots, np.ones(len(spots), bool)
        starts = self.starts[level]
        found = np.searchsorted(starts, spots)
        return found, starts[found] == spots

    def _rest(self, level: int, spots: np.ndarray, forward: bool) -> np.ndarray:
        """From each spot to the next border of a level, forward or back."""
        starts = self.starts[level]
        if forward:
            return starts[np.minimum(np.searchsorted(starts, spots, "right"), len(starts) - 1)] - spots
        return spots - starts[np.maximum(np.searchsorted(starts, spots, "left") - 1, 0)]

    def extensions(self, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
        """How far the sequence reads alike from places ``a`` and ``b`` on (``a < b``); backwards: before them."""
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        origin, level = b.copy(), np.zeros(len(a), np.int64)
        climbing, active = np.ones(len(a), bool), np.arange(len(a))
        top = len(self.starts) - 1
        while len(active):
            going = []
            for h in np.unique(level[active]):
                rows = active[level[active] == h]
                i, _ = self._index(h, a[rows])
                j, _ = self._index(h, b[rows])
                if h < top:
                    up = climbing[rows].copy()
                    up[up] = self._index(h + 1, a[rows[up]])[1] & self._index(h + 1, b[rows[up]])[1]
                    level[rows[up]] += 1
                    going.append(rows[up])
                    rows, i, j = rows[~up], i[~up], j[~up]
                starts, symbols = self.starts[h], self.symbols[h]
                if forward:
                    inside = (i < len(symbols)) & (j < len(symbols))
                    p, q = np.minimum(i, len(symbols) - 1), np.minimum(j, len(symbols) - 1)
                else:
                    inside = (i > 0) & (j > 0)
                    p, q = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
                same = inside & (symbols[p] == symbols[q])
                if h < top and self.blocks[h]:
                    # Equal symbols inside blocks: as many at once as both blocks still have.
                    width = np.minimum(self._rest(h + 1, a[rows], forward), self._rest(h + 1, b[rows], forward))
                else:
                    width = starts[p + 1] - starts[p]
                width = np.where(same, width, 0)
                a[rows] += width if forward else -width
                b[rows] += width if forward else -width
                stuck = rows[~same]
                climbing[stuck] = False
                level[stuck] -= 1
                going += [rows[same], stuck[level[stuck] >= 0]]
            active = np.concatenate(going) if going else active[:0]
        return np.abs(b - origin)
