"""Run-compressed Burrows-Wheeler index of many short texts.

Texts are rows of one matrix of symbols (byte + 1), filled up with 0; a 0 ends each text.  Suffixes are sorted by doubling
prefixes, equal suffixes by the number of their text, so that stepping to the left (LF) is exact.  Of the transform only
its runs are kept: head symbol, start, first row of the heads' next place, and the text positions sampled at both ends
of each run.
"""

from __future__ import annotations

import numpy as np


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of equal-sized keys, equal keys sharing theirs."""
    order = np.argsort(keys)
    ordered = keys[order]
    step = np.empty(len(keys), np.int64)
    step[:1] = 1
    step[1:] = ordered[1:] != ordered[:-1]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(step)
    return ranks


class RunIndex:
    """Index of ``rows`` (n x width, uint8, of ``sizes`` bytes each); ``depth``: bytes that make two positions alike."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, depth: int):
        n, width = rows.shape
        self.sizes, self.depth, self.n = sizes, depth, n
        inside = np.arange(width + 1) <= sizes[:, None]  # the end mark belongs to the text
        codes = np.zeros(257, np.uint64)
        present = np.unique(rows)
        codes[present.astype(np.int64) + 1] = np.arange(1, len(present) + 1, dtype=np.uint64)
        symbols = np.zeros((n, width + 1), np.uint64)
        symbols[:, :width] = codes[rows.astype(np.int64) + 1]
        symbols[~inside | (np.arange(width + 1) == sizes[:, None])] = 0
        bits = np.uint64(max(1, int(len(present)).bit_length()))
        self.text, self.at = np.nonzero(inside)  # of each suffix

        def shifted(m: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros_like(m)
            if by <= width:
                out[:, :width + 1 - by] = m[:, by:]
            return out

        # as many symbols as one word holds, then doubled until whole texts are compared
        reach = min(64 // int(bits), width + 1)
        key = np.zeros_like(symbols)
        for i in range(reach):
            key = (key << bits) | shifted(symbols, i)
        ranks = np.zeros((n, width + 1), np.int64)
        ranks[inside] = _dense(key[inside])
        alike = None
        while True:
            if alike is None and depth <= 2 * reach:
                alike = ranks, shifted(ranks, max(0, depth - reach)), reach
            if reach > width:
                break
            pair = ranks * (ranks.max() + 1) + shifted(ranks, reach)
            ranks = np.zeros_like(ranks)
            ranks[inside] = _dense(pair[inside])
            reach *= 2
        order = np.argsort(ranks[inside] * n + self.text)  # equal suffixes in the order of their texts
        self.text, self.at = self.text[order], self.at[order]
        first, second, _ = alike
        a, b = first[self.text, self.at], second[self.text, self.at]
        if depth < alike[2]:
            raise ValueError("depth is below the symbols of one word")
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.block = np.cumsum(new) - 1  # suffixes with the same first ``depth`` symbols

        before = symbols[self.text, np.maximum(self.at - 1, 0)].astype(np.int64)
        before[self.at == 0] = 0  # the end mark of the text before
        change = np.ones(len(before), bool)
        change[1:] = before[1:] != before[:-1]
        self.starts = np.flatnonzero(change)
        self.heads = before[self.starts]
        lengths = np.diff(self.starts, append=len(before))
        ends = self.starts + lengths - 1
        self.samples = np.column_stack((self.text[self.starts], self.at[self.starts], self.text[ends], self.at[ends]))
        # rows that start with a smaller symbol, then runs of the same head further up
        by_head = np.argsort(self.heads, kind="stable")
        self.to = np.empty(len(self.starts), np.int64)
        self.to[by_head] = np.cumsum(lengths[by_head]) - lengths[by_head]

    def left(self, row: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one symbol further to the left."""
        run = np.searchsorted(self.starts, row, "right") - 1
        return self.to[run] + row - self.starts[run]

    def stream(self, weight: np.ndarray):
        """For every text, from its end to its start: (texts, position, statistic).

        The statistic is the smallest ``weight`` of all texts with an occurrence of the ``depth`` bytes at that position; only
        positions with so many bytes are given.  Each step moves all texts one symbol through the runs.
        """
        least = np.minimum.reduceat(weight[self.text], np.flatnonzero(np.diff(self.block, prepend=-1)))
        texts = np.argsort(-self.sizes, kind="stable")
        sizes = self.sizes[texts]
        rows = texts.copy()  # an end mark's suffix stands at its text's number
        for step in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, "right"))
            rows[:live] = self.left(rows[:live])
            if step >= self.depth:
                yield texts[:live], sizes[:live] - step, least[self.block[rows[:live]]]
