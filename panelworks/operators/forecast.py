"""Forecast requests, a batch scoring job with a pluggable scorer, and what is read off its output."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.functions.windows import ordered
from panelworks.operators.panel import at_prior_end

# Contexts are padded to a multiple of this length, and are left-padded with zero unless
# they are prices; fewer observations than this make no request.
PATCH = 32
MIN_OBSERVATIONS = 64

FORECAST_SCHEMA = "symbol string, date date, mean array<double>, q array<array<double>>"

# Takes contexts of one shape (rows x length) and a horizon; returns the mean path (rows x horizon) and
# quantile paths (rows x horizon x quantiles), or None for the latter.
Scorer = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray | None]]


@dataclass(frozen=True)
class Paths:
    """A scorer made of column expressions: from a context and a horizon, the mean path and quantile paths or None.
    It needs no Python worker."""

    of: Callable[[Column, int], tuple[Column, Column | None]]


def context_requests(
    series: DataFrame, value: str, dates: DataFrame, context_len: int, min_obs: int = MIN_OBSERVATIONS
) -> DataFrame:
    """(symbol, date, series): the last ``context_len + 4`` sessions up to the prior end, gaps dropped.

    The series is gathered by a bounded row frame, and only where a decision date needs it.
    """
    frame = ordered().rowsBetween(-(context_len + 3), 0)
    gathered = series.select("symbol", "date", F.collect_list(value).over(frame).alias("series"))
    at = at_prior_end(gathered, dates).select("symbol", "date", "series")
    return at.filter(F.size("series") >= min_obs)


def missing_requests(requests: DataFrame, stored: DataFrame) -> DataFrame:
    return requests.join(stored.select("symbol", "date"), ["symbol", "date"], "left_anti")


def patch_align(length: int) -> int:
    return max(PATCH, -(-length // PATCH) * PATCH)


def prepared_context(series: Column | str, context_len: int, kind: str) -> Column:
    """Finite values only, right-aligned to the padded length; an empty series is one zero."""
    series = F.col(series) if isinstance(series, str) else series
    length = patch_align(context_len)
    finite = F.filter(series, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    finite = F.when(F.size(finite) == 0, F.array(F.lit(0.0))).otherwise(finite)
    tail = F.when(F.size(finite) > length, F.slice(finite, -length, length)).otherwise(finite)
    pad = F.element_at(tail, 1) if kind == "price" else F.lit(0.0)
    return F.concat(F.array_repeat(pad, F.lit(length) - F.size(tail)), tail)


def forecast(requests: DataFrame, scorer: Scorer | Paths, horizon: int, context_len: int, kind: str) -> DataFrame:
    """Score requests where they are: by expressions, or by a supplied scorer partition by partition in Arrow batches.
    No shuffle; a batch is all a task holds."""
    ready = requests.select("symbol", "date", prepared_context("series", context_len, kind).alias("context"))

    if isinstance(scorer, Paths):
        mean, quantiles = scorer.of(F.col("context"), horizon)
        none = F.lit(None).cast("array<array<double>>")
        return ready.select("symbol", "date", mean.alias("mean"), (none if quantiles is None else quantiles).alias("q"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            mean, quantiles = scorer(np.stack(batch["context"].to_list()).astype("float64"), horizon)
            paths = [None] * len(batch) if quantiles is None else [p.tolist() for p in quantiles]
            yield pd.DataFrame({"symbol": batch["symbol"], "date": batch["date"], "mean": list(mean), "q": paths})

    return ready.mapInPandas(run, FORECAST_SCHEMA)


def forecast_panel(
    requests: DataFrame, stored: DataFrame, scorer: Scorer | Paths, horizon: int, context_len: int, kind: str
) -> DataFrame:
    """Whole store after scoring only the keys it lacks; stored rows are kept."""
    fresh = forecast(missing_requests(requests, stored), scorer, horizon, context_len, kind)
    return stored.unionByName(fresh)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.size(values)


def _tail(context: Column, window: int) -> Column:
    return F.slice(context, -F.least(F.lit(window), F.size(context)), F.lit(window))


def trailing_mean_scorer(window: int = 21) -> Paths:
    """Flat path at the mean of the last ``window`` values of the context."""
    return Paths(lambda context, horizon: (F.array_repeat(_mean(_tail(context, window)), horizon), None))


def drift_scorer() -> Paths:
    """Straight line through the context's first and last value, continued."""

    def paths(context: Column, horizon: int):
        last = F.element_at(context, -1)
        slope = (last - F.element_at(context, 1)) / F.greatest(F.size(context) - 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda step: last + slope * step), None

    return Paths(paths)


def empirical_quantile_scorer(levels: Sequence[float], window: int = 64) -> Paths:
    """Flat paths at the context's empirical quantiles (linear between neighbours), the mean in the middle."""

    def paths(context: Column, horizon: int):
        tail = F.array_sort(_tail(context, window))

        def quantile(level: float) -> Column:
            at = (F.size(tail) - 1) * F.lit(float(level))
            low, high = F.element_at(tail, F.floor(at).cast("int") + 1), F.element_at(tail, F.ceil(at).cast("int") + 1)
            return low + (high - low) * (at - F.floor(at))

        step = F.array(*[quantile(level) for level in levels])
        return F.array_repeat(_mean(tail), horizon), F.array_repeat(step, horizon)

    return Paths(paths)


def mean_sum(horizon: int, column: str = "mean") -> Column:
    """Sum of the first ``horizon`` steps of the mean path."""
    return F.aggregate(F.slice(column, 1, horizon), F.lit(0.0), lambda a, x: a + x)


def quantile_path(index: int, horizon: int, column: str = "q") -> Column:
    """Steps of one quantile, addressed by position because the columns carry no reliable label."""
    return F.transform(F.slice(column, 1, horizon), lambda step: F.element_at(step, index + 1))


def quantile_mean(index: int, horizon: int, column: str = "q") -> Column:
    total = F.aggregate(quantile_path(index, horizon, column), F.lit(0.0), lambda a, x: a + x)
    return total / horizon


def forecast_wide(forecasts: DataFrame, value: str, symbols: Sequence[str]) -> DataFrame:
    """date x symbol view, for the symbols asked for."""
    return forecasts.groupBy("date").pivot("symbol", list(symbols)).agg(F.first(value))


def coverage(forecasts: DataFrame, dates: DataFrame) -> DataFrame:
    """Share of the dates that have any forecast."""
    have = forecasts.select("date").distinct().withColumn("_have", F.lit(1))
    hit = dates.select("date").join(F.broadcast(have), "date", "left")
    return hit.agg((F.count("_have") / F.greatest(F.count("*"), F.lit(1))).alias("coverage"))


def training_windows(
    returns: DataFrame, value: str, length: int, horizon: int, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Every window of ``length`` observed values with the sum of the next ``horizon`` as label, dated by
    the symbol's own first label day. Gaps are dropped before windows are cut."""
    observed = returns.filter(F.col(value).isNotNull())
    w = ordered()
    cut = observed.select(
        "symbol",
        "date",
        F.collect_list(value).over(w.rowsBetween(-length, -1)).alias("window"),
        F.sum(value).over(w.rowsBetween(0, horizon - 1)).alias("label"),
        F.count(value).over(w.rowsBetween(0, horizon - 1)).alias("_steps"),
    ).filter((F.size("window") == length) & (F.col("_steps") == horizon))
    if start is not None:
        cut = cut.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        cut = cut.filter(F.col("date") <= F.lit(end).cast("date"))
    return cut.drop("_steps")


def sample_hash(seed: int, keys: Sequence[str] = ("symbol", "date")) -> Column:
    """60 bits of the MD5 of the seed and the row's keys as text, which SQL can follow."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sample_windows(windows: DataFrame, n: int, seed: int, keys: Sequence[str] = ("symbol", "date"), edge: int = 10_000) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer): those whose keys have the smallest hashes under ``seed``.

    Rows are counted by the upper bits of their hashes; the bucket in which the n-th row falls is split further until it
    has at most ``edge`` rows, and only these are ordered. Rows below it are taken where they stand. So the sample
    depends on seed and keys and not on partitioning, and no more than one histogram at a time reaches the driver.
    """
    hashed = windows.withColumn("_hash", sample_hash(seed, keys))
    bits, shift, prefix, left = 12, 60, 0, n
    while shift:
        shift -= bits
        inside = hashed.where(F.shiftright("_hash", shift + bits) == prefix)
        counts = inside.groupBy(F.shiftright("_hash", shift).alias("bucket")).count().orderBy("bucket").collect()
        if shift == 60 - bits and sum(row["count"] for row in counts) <= n:
            return windows
        for row in counts:
            if left < row["count"]:
                break
            left -= row["count"]
        prefix, size = row["bucket"], row["count"]
        if not left or size <= edge:
            break
    bucket = F.shiftright("_hash", shift)
    below = hashed.where(bucket < prefix).drop("_hash")
    order = Window.partitionBy(F.lit(0)).orderBy("_hash", *keys)
    rest = hashed.where(bucket == prefix).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= left)
    return below.unionByName(rest.drop("_hash", "_place"))


def pinball(pairs: DataFrame, quantiles: Sequence[float], prefix: str = "q", target: str = "y") -> DataFrame:
    """Mean pinball loss over rows and quantiles, and the squared error of ``mean``."""
    losses = []
    for i, q in enumerate(quantiles):
        e = F.col(target) - F.col(f"{prefix}{i}")
        losses.append(F.avg(F.greatest(q * e, (q - 1) * e)))
    total = losses[0]
    for loss in losses[1:]:
        total = total + loss
    error = F.col(target) - F.col("mean")
    return pairs.agg((total / len(losses)).alias("pinball"), F.avg(error * error).alias("squared_error"))
