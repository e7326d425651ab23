"""Column-wise sorting of text pieces: order, Burrows-Wheeler column and common prefixes, one symbol a round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _range_min(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of values[begin:end] for each non-empty range, from minima of runs of doubled length."""
    levels = [values]
    while 1 << len(levels) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    depth = np.log2(end - begin).astype(np.int64)
    out = np.empty(len(begin), values.dtype)
    for level in np.unique(depth):
        at = np.flatnonzero(depth == level)
        row = levels[level]
        out[at] = np.minimum(row[begin[at]], row[end[at] - (1 << int(level))])
    return out


def insert_columns(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Column, order of the rows by their suffixes from there, and common prefix of each with the one before.

    ``symbols`` holds one aligned piece a row, 0 where it has no symbol. Rounds go from the last column to the first;
    each puts one symbol of every piece in front of its suffix. The symbols in the order of the round before are a
    column of the collection's Burrows-Wheeler transform: sorting them stably gives the new order, and a common prefix
    is one more than the least of those between two equal symbols, or 0.
    """
    count, width = symbols.shape
    order = np.arange(count)
    common = np.zeros(count, np.int16)
    for column in range(width - 1, -1, -1):
        transform = symbols[order, column]
        moved = np.argsort(transform, kind="stable")
        sorted_ = transform[moved]
        equal = np.flatnonzero((sorted_[1:] == sorted_[:-1]) & (sorted_[1:] != 0)) + 1
        fresh = np.zeros(count, np.int16)
        if len(equal):
            fresh[equal] = _range_min(common, moved[equal - 1] + 1, moved[equal] + 1) + 1
        order, common = order[moved], fresh
        yield column, order, common
