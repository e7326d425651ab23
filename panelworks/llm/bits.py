"""Fixed-size bit filters over hashed windows of all documents, built in parts and sent to the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelworks.llm.staging import stored

#: Bits of one filter: 16 MiB, whatever the input. A fuller filter lets more through and loses nothing.
BITS = 1 << 27
_PARTS = 64
_PART = BITS // _PARTS


def slots(hashed: np.ndarray, turn: int) -> np.ndarray:
    """The filter position of each hash, independent for turns 0 and 1."""
    return (hashed >> np.uint64(37 if turn else 2)) & np.uint64(BITS - 1)


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def holds(filters: list[np.ndarray], hashed: np.ndarray) -> np.ndarray:
    out = is_set(filters[0], slots(hashed, 0))
    at = np.flatnonzero(out)
    out[at] = is_set(filters[1], slots(hashed[at], 1))
    return out


def collect_bits(
    docs: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], *leasts: int
) -> list[list[np.ndarray]]:
    """For each of ``leasts`` (1 to 255) two filters of the slots that at least so many of the hashes fall into.

    ``hashes_of`` yields the hashes of a slice of a batch. A slice sends each slot once, or twice if it saw it twice.
    What the driver collects and broadcasts is filters of BITS bits.
    """
    most = max(leasts)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashed in hashes_of(batch):
                parts, blobs = [], []
                for turn in range(2):
                    at, times = np.unique(slots(hashed, turn), return_counts=True)
                    at = np.sort(np.concatenate((at, at[times > 1]))) if most > 1 else at
                    cuts = np.searchsorted(at, np.arange(_PARTS + 1, dtype=np.uint64) * np.uint64(_PART))
                    for part in range(_PARTS):
                        own = at[cuts[part] : cuts[part + 1]]
                        if len(own):
                            parts.append(turn * _PARTS + part)
                            blobs.append(np.diff(own, prepend=np.uint64(part * _PART)).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "slots"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                count = counts.setdefault(part, np.zeros(_PART, np.uint8))
                at, times = np.unique(np.cumsum(np.frombuffer(blob.as_buffer(), np.uint32)), return_counts=True)
                count[at] = np.minimum(count[at] + times, 255)
        for level, least in enumerate(leasts):
            blobs = [np.packbits(count >= least, bitorder="little").tobytes() for count in counts.values()]
            parts = [level * 2 * _PARTS + part for part in counts]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "bits"])

    rows = docs.mapInArrow(sent, "part int, slots binary").repartition(2 * _PARTS, "part").mapInArrow(merged, "part int, bits binary")
    filters = np.zeros((len(leasts), 2, _PARTS, _PART // 8), np.uint8)
    for row in stored(rows, "bits").toLocalIterator():
        filters.reshape(-1, _PART // 8)[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return [[turn.ravel() for turn in level] for level in filters]
