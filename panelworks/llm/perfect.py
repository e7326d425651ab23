"""A minimal perfect hash over distinct 64-bit keys, built by buckets in Spark, with verified look-ups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelworks.llm.words import group_edges, scramble, whole_groups

#: Keys that a bucket is meant to hold, and slots per key that is still to be placed.
PER_BUCKET, ROOM = 1 << 12, 2
_TURN = np.uint64(0x9E3779B97F4A7C15)


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bucket among ``2 ** bits``."""
    if not bits:
        return np.zeros(len(keys), np.int64)
    return (scramble(keys ^ _TURN) >> np.uint64(64 - bits)).astype(np.int64)


def _slot(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    turn = np.uint64((level + 1) * int(_TURN) % (1 << 64))
    return (scramble(keys + turn) % np.asarray(size, np.uint64)).astype(np.int64)


def place(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits end to end, and the keys in order of their bits.

    On each level a key that has a slot to itself takes it; the others go on to the next one.
    """
    sizes, bits, order = [], [], []
    while len(keys):
        size = ROOM * len(keys)
        slot = _slot(keys, len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        settled = alone[slot]
        mine = keys[settled]
        order.append(mine[np.argsort(slot[settled])])
        sizes.append(size)
        bits.append(alone)
        keys = keys[~settled]
    joined = np.concatenate(bits) if bits else np.zeros(0, bool)
    return sizes, joined, np.concatenate(order) if order else np.zeros(0, np.uint64)


def build(distinct: DataFrame, keys: int) -> DataFrame:
    """``bucket, sizes, bits, keys`` of the distinct long column ``key``, of which there are ``keys``.

    A bucket is placed in one task; hashing gives each about PER_BUCKET keys.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, keys) / PER_BUCKET))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(found.view(np.uint64), bits)), pa.array(found)], ["bucket", "key"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1):
            edges = group_edges(table, 1)
            found, buckets = table.column(1).to_numpy().view(np.uint64), table.column(0).to_numpy()
            for begin, end in zip(edges[:-1], edges[1:]):
                sizes, filled, order = place(found[begin:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(buckets[begin])], pa.int64()),
                        pa.array([sizes], pa.list_(pa.int64())),
                        pa.array([np.packbits(filled, bitorder="little").tobytes()], pa.binary()),
                        pa.array([order.tobytes()], pa.binary()),
                    ],
                    ["bucket", "sizes", "bits", "keys"],
                )

    dealt = distinct.select("key").mapInArrow(deal, "bucket long, key long")
    placed = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(settle, "bucket long, sizes array<long>, bits binary, keys binary").withColumn("of", F.lit(1 << bits))


class PerfectHash:
    """Some of the buckets, in order: index of a key among theirs, or -1 for one that is not in them."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda row: row["bucket"])
        self.bits = int(rows[0]["of"]).bit_length() - 1 if rows else 0
        self.levels = max((len(row["sizes"]) for row in rows), default=0)
        self.row = np.full(1 << self.bits, -1, np.int32)
        self.row[[row["bucket"] for row in rows]] = np.arange(len(rows))
        self.size = np.zeros((len(rows), self.levels), np.int64)
        for i, row in enumerate(rows):
            self.size[i, : len(row["sizes"])] = row["sizes"]
        self.start = (np.cumsum(self.size.ravel()) - self.size.ravel()).reshape(self.size.shape)
        filled = [np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"]), bitorder="little") for row in rows]
        flat = np.concatenate(filled) if filled else np.zeros(0, np.uint8)
        flat = np.append(flat, np.zeros(-len(flat) % 64 + 64, np.uint8))
        self.words = np.packbits(flat, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.keys = np.concatenate([np.frombuffer(row["keys"], np.uint64) for row in rows]) if rows else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.keys)

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        row = self.row[bucket_of(keys, self.bits)]
        todo = np.flatnonzero(row >= 0)
        for level in range(self.levels):
            size = self.size[row[todo], level]
            todo, size = todo[size > 0], size[size > 0]
            at = self.start[row[todo], level] + _slot(keys[todo], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            under = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = (self.before[at >> 6] + np.bitwise_count(under))[hit]
            todo = todo[~hit]
        found = np.flatnonzero(out >= 0)
        wrong = found[self.keys[out[found]] != keys[found]]
        out[wrong] = -1
        return out
