"""Many partial results of tasks brought to one per key, a few at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelworks.llm.staging import stored
from panelworks.llm.words import groups

PARTIAL = "key long, lot long, state binary"
#: Partial results that one step of the tree brings together.
FAN_IN = 16


def fold_tree(partial: DataFrame, combine: Callable[[Iterator[bytes]], bytes], label: str, fan_in: int | None = None) -> DataFrame:
    """``key, state`` with one state per key of ``partial`` (``key, lot, state``; lots number the states of a key).

    Each level brings up to ``fan_in`` neighbouring lots together, so a task holds one combined state and one more,
    whatever the number of tasks; ``combine`` gets an iterator in order of lots.
    """
    fan_in = fan_in or FAN_IN
    rows = stored(partial, f"{label}-partial")
    most = rows.agg(F.max("lot")).first()[0] or 0

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 2):
            state = combine(blob.as_buffer().to_pybytes() for blob in group.column(2))
            yield pa.RecordBatch.from_arrays(
                [group.column(0)[:1].combine_chunks(), group.column(1)[:1].combine_chunks(), pa.array([state], pa.binary())],
                ["key", "lot", "state"],
            )

    while True:
        most //= fan_in
        lots = rows.select("key", F.floor(F.col("lot") / fan_in).alias("lot"), "lot", "state").toDF("key", "lot", "place", "state")
        dealt = lots.repartition("key", "lot").sortWithinPartitions("key", "lot", "place").select("key", "lot", "state")
        rows = dealt.mapInArrow(fold, PARTIAL)
        if most == 0:
            return stored(rows.select("key", "state"), f"{label}-folded")
