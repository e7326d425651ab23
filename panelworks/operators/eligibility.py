"""Which symbols may be bought on a session."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from panelworks.settings import Eligible
from panelworks.functions.windows import ordered, running
from panelworks.operators.indicators import avg_dollar_volume


def base_mask(prices: DataFrame, membership: DataFrame, rules: Eligible, trend: DataFrame | None = None) -> DataFrame:
    """(symbol, date, eligible): member, with enough history, price and liquidity as of the previous
    session, and in an up-trend when ``trend`` (already lagged ``trend_filter`` and ``sma_crossover``)
    is given. Dollar volume reaches this filter already lagged once, so it is two sessions old."""
    return mask_versions(prices, membership, {"eligible": rules}, trend)


def mask_versions(
    prices: DataFrame, membership: DataFrame, versions: Mapping[str, Eligible], trend: DataFrame | None = None
) -> DataFrame:
    """``base_mask`` under several rules at once: one column per name, from one measurement of the prices."""
    w = ordered()
    measured = avg_dollar_volume(prices, out="_traded_mean").select(
        "symbol", "date", F.count("close").over(running()).alias("_sessions"), "close", "_traded_mean"
    )
    lagged = measured.select(
        "symbol",
        "date",
        F.lag("_sessions", 1).over(w).alias("_sessions"),
        F.lag("close", 1).over(w).alias("_close"),
        F.lag("_traded_mean", 2).over(w).alias("_traded_mean"),
    )
    members = membership.select("symbol", "date", F.lit(True).alias("_member"))
    out = lagged.join(members, ["symbol", "date"], "left")
    always = F.coalesce("_member", F.lit(False))
    if trend is not None:
        rising = (F.col("trend_filter") > 0) & (F.col("sma_crossover") > 0)
        flags = trend.select("symbol", "date", F.coalesce(rising, F.lit(False)).alias("_rising"))
        out = out.join(flags, ["symbol", "date"], "left")
        always = always & F.coalesce("_rising", F.lit(False))

    def holds(rules: Eligible) -> Column:
        known = (
            (F.col("_sessions") >= rules.sessions)
            & (F.col("_close") >= rules.price)
            & (F.col("_traded_mean") >= rules.dollar_volume)
        )
        return always & F.coalesce(known, F.lit(False))

    return out.select("symbol", "date", *[holds(rules).alias(name) for name, rules in versions.items()])


def eligible_symbols(mask: DataFrame) -> DataFrame:
    return mask.filter("eligible").select("symbol", "date")


def enough_history(prices: DataFrame, min_history_days: int) -> DataFrame:
    """Symbols with at least that many closes over the whole panel."""
    counts = prices.groupBy("symbol").agg(F.count("close").alias("n_close"))
    return counts.filter(F.col("n_close") >= min_history_days)


def requested_window(ends: DataFrame, start: str | None = None, lookback_years: int | None = None) -> DataFrame:
    """``ends`` has one row with ``requested_end``; the start is explicit, or a number of years back, or
    the fixed first date."""
    if start is not None:
        first = F.lit(start).cast("date")
    elif lookback_years is not None:
        first = F.add_months("requested_end", -12 * lookback_years)
    else:
        first = F.lit("1996-01-01").cast("date")
    return ends.withColumn("requested_start", first)


def effective_window(requested: DataFrame, benchmark: DataFrame, membership: DataFrame, train_years: int) -> DataFrame:
    """One row: the study starts when requested, but not before the benchmark's first close or the first
    session with members; loading starts earlier by the training window plus two years."""
    bench = benchmark.filter("close is not null").agg(F.min("date").alias("benchmark_start"))
    members = membership.agg(F.min("date").alias("membership_start"))
    return (
        requested.crossJoin(bench)
        .crossJoin(members)
        .withColumn("effective_start", F.greatest("requested_start", "benchmark_start", "membership_start"))
        .withColumn("load_start", F.add_months("requested_start", -12 * (train_years + 2)))
    )


def primary_window(frame: DataFrame, start: str, as_of_year: int | None = None) -> DataFrame:
    """Dates from ``start`` on; with ``as_of_year`` also without that partial year and later ones."""
    kept = frame.filter(F.col("date") >= F.lit(start).cast("date"))
    return kept if as_of_year is None else kept.filter(F.year("date") < as_of_year)
