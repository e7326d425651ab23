"""Window building blocks.

Row frames run over *grid* rows, so the input has to be dense on sessions. A partition here is one
symbol (or run), whose length is bounded by the trading calendar, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

Keys = Sequence[str]

def ordered(keys: Keys = ("symbol",), order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, keys: Keys = ("symbol",), order: str = "date") -> WindowSpec:
    return ordered(keys, order).rowsBetween(-(n - 1), 0)


def running(keys: Keys = ("symbol",), order: str = "date") -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def default_min_periods(n: int) -> int:
    return max(2, n // 2)


def rolling(
    value: Column | str,
    n: int,
    min_periods: int | None = None,
    agg: Callable[[Column], Column] = F.avg,
    keys: Keys = ("symbol",),
    order: str = "date",
) -> Column:
    """Rolling aggregate that is NULL until ``min_periods`` non-null values are in the frame.

    Every frame is added up by itself, which suits short frames and aggregates other than means; long means are
    cheaper with :func:`with_rolling_means`."""
    value = F.col(value) if isinstance(value, str) else value
    need = default_min_periods(n) if min_periods is None else min_periods
    frame = trailing(n, keys, order)
    return F.when(F.count(value).over(frame) >= need, agg(value).over(frame))


class Mean(NamedTuple):
    """A rolling mean of a column over ``n`` rows, shown from ``need`` values on (None: the default)."""

    value: str
    n: int
    need: int | None = None


def with_rolling_means(
    frame: DataFrame, means: Mapping[str, Mean], keys: Keys = ("symbol",), order: str = "date"
) -> DataFrame:
    """``frame`` with one rolling mean per name in ``means``.

    Sums over 1, 2, 4, ... rows come from one another by one look back each, and a frame is put together from the powers
    of two in its length: log2(n) additions per row instead of n, over one sort, for all means at once. Nothing is
    subtracted but counts, so a huge value leaves no trace once it is out of the frame.
    """
    kept = frame.columns
    w = ordered(keys, order)
    longest: dict[str, int] = {}
    for mean in means.values():
        longest[mean.value] = max(longest.get(mean.value, 1), mean.n)
    place = {value: i for i, value in enumerate(longest)}
    out = frame.withColumns(
        {f"_sum{i}_1": F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v, i in place.items()}
        | {f"_seen{i}": F.count(v).over(running(keys, order)) for v, i in place.items()}
    )
    size = 1
    while 2 * size <= max(longest.values()):
        grown = {
            f"_sum{place[v]}_{2 * size}": F.col(f"_sum{place[v]}_{size}") + F.lag(f"_sum{place[v]}_{size}", size, 0.0).over(w)
            for v, most in longest.items()
            if 2 * size <= most
        }
        out = out.withColumns(grown)
        size *= 2
    shown = {}
    for name, mean in means.items():
        i, at, total = place[mean.value], 0, F.lit(0.0)
        for power in [1 << b for b in reversed(range(mean.n.bit_length())) if mean.n >> b & 1]:
            part = F.col(f"_sum{i}_{power}")
            total = total + (F.lag(part, at, 0.0).over(w) if at else part)
            at += power
        count = F.col(f"_seen{i}") - F.lag(f"_seen{i}", mean.n, 0).over(w)
        need = default_min_periods(mean.n) if mean.need is None else mean.need
        shown[name] = F.when(count >= F.lit(max(need, 1)), total / count)
    return out.select(*kept, *[mean.alias(name) for name, mean in shown.items()])


def filled(value: Column | str, keys: Keys = ("symbol",), order: str = "date") -> Column:
    """Last non-null value so far."""
    value = F.col(value) if isinstance(value, str) else value
    return F.last(value, ignorenulls=True).over(running(keys, order))


def padded_change(value: Column | str, keys: Keys = ("symbol",), order: str = "date") -> Column:
    """Percent change after forward-filling gaps. Both fills are running windows over one sort."""
    value = F.col(value) if isinstance(value, str) else value
    now = filled(value, keys, order)
    before = F.last(value, ignorenulls=True).over(
        ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.try_divide(now, before) - 1
