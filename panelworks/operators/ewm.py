"""Exponentially weighted means, the one recursion that no built-in window expresses.

Spark shuffles by symbol; inside a task pandas walks one symbol's series, whose length is bounded by the
calendar. All requested series come out of one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


@dataclass(frozen=True)
class Ewm:
    """``out`` = mean of ``source`` (a column, or the difference ``(a, b)`` of two of them, earlier
    outputs included) with decay ``alpha``. NULLs keep decaying the past; the mean shows once
    ``min_periods`` values were observed."""

    out: str
    source: str | tuple[str, str]
    alpha: float
    min_periods: int

    @classmethod
    def span(cls, out: str, source: str | tuple[str, str], span: int) -> "Ewm":
        return cls(out, source, 2.0 / (span + 1.0), max(2, span // 2))


def ewm_columns(
    frame: DataFrame, specs: Sequence[Ewm], key: str = "symbol", order: str = "date", keep: Sequence[str] | None = None
) -> DataFrame:
    """The ``keep`` columns (default: all) plus one column per spec. Kept columns pass through as Arrow
    buffers; only the averaged series are turned into pandas."""
    keep = list(frame.columns if keep is None else keep)
    schema = StructType([frame.schema[c] for c in keep] + [StructField(s.out, DoubleType()) for s in specs])

    def one_symbol(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        series: dict[str, pd.Series] = {}

        def column(name: str) -> pd.Series:
            if name not in series:
                series[name] = table.column(name).to_pandas().astype("float64")
            return series[name]

        for spec in specs:
            source = spec.source
            values = column(source[0]) - column(source[1]) if isinstance(source, tuple) else column(source)
            ewm = values.ewm(alpha=spec.alpha, adjust=False, min_periods=spec.min_periods)
            series[spec.out] = ewm.mean()
        out = table.select(keep)
        for spec in specs:
            out = out.append_column(spec.out, pa.array(series[spec.out], type=pa.float64(), from_pandas=True))
        return out

    return frame.groupBy(key).applyInArrow(one_symbol, schema)
