"""Words, shingles and windows of Arrow text columns as NumPy arrays, a bounded slice of whole texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a slice of its own. A byte takes 64 in arrays of hashes and powers.
SLICE = 1 << 18
#: Powers that a worker keeps of a base, at most; for longer texts they are made anew.
_KEPT = 1 << 22
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts (null: empty) as first row, bytes, and offsets of each text in these."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1, first + 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _FOLD[data]


def words(data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the index of its text. Words never cross texts."""
    inside = ~spaces[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    begins = np.flatnonzero(after & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~after))
    return begins, ends, (np.searchsorted(offsets, begins, "right") - 1).astype(np.int64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _letters(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), int(rng.integers(1 << 61, 1 << 62)) * 2 + 1


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2**64 and of its inverse."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) <= n:
        size = -(-(n + 1) // SLICE) * SLICE
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            column = np.full(size, b, dtype=np.uint64)
            column[0] = 1
            made.append(np.cumprod(column, dtype=np.uint64))
        if n > _KEPT:
            return made[0], made[1]
        _POWERS[base] = known = (made[0], made[1])
    return known


def spans(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each values[begin:end], the same wherever these stand, from one running sum."""
    up, down = _powers(base, len(values))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return scramble((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64))


#: The base of byte hashes. Seeds differ in what each byte counts for, so the powers are kept once.
_BYTE_BASE = _letters(0)[1]


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each byte span."""
    return spans(_letters(seed)[0][data], begins, ends, _BYTE_BASE)


def rolling_hashes(data: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """What :func:`hashes` gives for the span of ``length`` bytes from each place on, across texts as well."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(_BYTE_BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters(seed)[0][data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    some = total[length:] - total[:-length]
    some *= down[: len(some)]
    some += np.uint64(length)
    return scramble(some)


def runs(hashed: np.ndarray, owner: np.ndarray, length: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """First index and hash of every run of ``length`` consecutive words of one text."""
    if len(hashed) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begins = np.flatnonzero(owner[: len(owner) - length + 1] == owner[length - 1 :])
    return begins, spans(hashed, begins, begins + length, _letters(seed)[1])


def long_ids(column: pa.Array, null: int) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def group_edges(table: pa.Table | pa.RecordBatch, keys: int) -> np.ndarray:
    """Where each run of rows that agree in their first ``keys`` columns begins, and the end."""
    fresh = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for i in range(keys):
        column = table.column(i).to_numpy()
        fresh |= column[1:] != column[:-1]
    return np.concatenate(([0], np.flatnonzero(fresh) + 1, [table.num_rows])) if table.num_rows else np.zeros(1, np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows in which no run that agrees in the first ``keys`` columns is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = group_edges(batch, keys)
        joins = bool(held) and all(held[-1].column(i)[-1] == batch.column(i)[0] for i in range(keys))
        if len(edges) == 2 and joins:
            held.append(batch)
            continue
        if held:
            yield pa.Table.from_batches([*held, batch.slice(0, edges[-2])] if len(edges) > 2 or not joins else held)
            held = []
            batch = batch.slice(edges[-2])
        elif len(edges) > 2:
            yield pa.Table.from_batches([batch.slice(0, edges[-2])])
            batch = batch.slice(edges[-2])
        held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of all consecutive rows that agree in their first ``keys`` columns."""
    for table in whole_groups(batches, keys):
        edges = group_edges(table, keys)
        for begin, end in zip(edges[:-1], edges[1:]):
            yield table.slice(begin, end - begin)
