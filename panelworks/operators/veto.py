"""Vetoes and score adjustments from forecasts and trailing volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelworks.functions.scalar import ratio
from panelworks.functions.windows import Mean, with_rolling_means
from panelworks.operators.panel import asof, at_prior_end
from panelworks.operators.xsection import below_quantile, zscore


def trailing_volume(prices: DataFrame, dates: DataFrame, window: int, out: str = "trailing") -> DataFrame:
    """Mean volume over the last ``window`` sessions known at each date's prior end."""
    tv = with_rolling_means(prices.select("symbol", "date", "volume"), {out: Mean("volume", window, 1)})
    return at_prior_end(tv, dates).select("symbol", "date", out)


def levels_at(levels: DataFrame, dates: DataFrame, fill: bool = True) -> DataFrame:
    """Forecast level in force on each date. With ``fill`` it comes from the last forecast date at or
    before; a symbol that has no forecast on that date stays without one."""
    if not fill:
        return levels.join(F.broadcast(dates.select("date")), "date", "left_semi").select("symbol", "date", "level")
    one = F.lit(0).alias("_key")
    made = levels.select(one, "date", F.col("date").alias("_made")).distinct()
    in_force = asof(dates.select(one, "date"), made, ["_made"], "_key").filter("_made is not null")
    stamped = in_force.select(F.col("_made").alias("date"), F.col("date").alias("_at"))
    return levels.join(F.broadcast(stamped), "date").select("symbol", F.col("_at").alias("date"), "level")


def volume_ratios(levels: DataFrame, prices: DataFrame, dates: DataFrame, window: int, fill: bool = True) -> DataFrame:
    """(symbol, date, ratio): forecast volume over trailing volume; NULL where either is missing."""
    tv = trailing_volume(prices, dates, window)
    both = tv.join(levels_at(levels, dates, fill), ["symbol", "date"], "left")
    return both.select("symbol", "date", ratio("level", F.when(F.col("trailing") > 0, F.col("trailing"))).alias("ratio"))


def absolute_veto(ratios: DataFrame, threshold: float) -> DataFrame:
    return ratios.withColumn("vetoed", F.coalesce(F.col("ratio") < threshold, F.lit(False)))


def relative_veto(ratios: DataFrame, share: float) -> DataFrame:
    return below_quantile(ratios, "ratio", share, out="vetoed")


def naive_ratios(prices: DataFrame, dates: DataFrame, window: int, short: int = 21) -> DataFrame:
    """Recent over longer trailing volume, without any forecast."""
    means = {"_short": Mean("volume", short, 1), "_long": Mean("volume", window, 1)}
    tv = with_rolling_means(prices.select("symbol", "date", "volume"), means)
    at = at_prior_end(tv, dates)
    return at.select("symbol", "date", ratio("_short", F.when(F.col("_long") > 0, F.col("_long"))).alias("ratio"))


def forecast_measures(readings: DataFrame, prices: DataFrame, dates: DataFrame, window: int = 63) -> DataFrame:
    """What the rules of :func:`sequential_vetoes` judge, at each date: ``readings`` (symbol, date, ``volume``,
    ``short_volume``, ``price`` and any others) with the volumes over trailing volume and the price over the last close,
    both of the prior end; NULL where a side is missing or not positive."""
    known = with_rolling_means(prices.select("symbol", "date", "close", "volume"), {"_trailing": Mean("volume", window, 1)})
    at = at_prior_end(known, dates).select("symbol", "date", "_trailing", F.col("close").alias("_close"))
    both = readings.join(at, ["symbol", "date"])

    def over(value: str, base: str) -> Column:
        return ratio(value, F.when(F.col(base) > 0, F.col(base)))

    others = [c for c in readings.columns if c not in ("symbol", "date", "volume", "short_volume", "price")]
    return both.select(
        "symbol",
        "date",
        over("volume", "_trailing").alias("volume_ratio"),
        over("short_volume", "_trailing").alias("short_ratio"),
        over("price", "_close").alias("price_ratio"),
        *others,
    )


def soft_adjustment(score: Column, r: Column, veto: float, soft: float = 0.0, confidence: float = 0.0) -> Column:
    """Vetoed scores are NULL; a ratio below ``soft`` shrinks the score, one above 1 lifts it."""
    out = F.when(r < veto, F.lit(None).cast("double"))
    if soft > 0:
        out = out.when(r < soft, score * r / soft)
    if confidence > 0:
        out = out.when(r > 1, score * (1 + confidence * (r - 1)))
    return out.otherwise(score)


def sequential_vetoes(scores: DataFrame, rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Rules (name, column, threshold) drop a score whose value is known and below the threshold. The
    first rule that applies is the ``reason``, as if each ran on the survivors of the ones before."""
    reason = F.lit(None).cast("string")
    for name, column, threshold in reversed(rules):
        reason = F.when(F.col(column) < threshold, F.lit(name)).otherwise(reason)
    return scores.withColumn("reason", reason)


def spared(judged: DataFrame, dates: DataFrame) -> DataFrame:
    """What :func:`sequential_vetoes` left of the sessions in ``dates``. A session all of whose names were dropped has
    none: nothing is carried over from an earlier one."""
    return judged.filter("reason is null").join(F.broadcast(dates), "date", "left_semi").drop("reason")


def apply_veto(scores: DataFrame, vetoes: DataFrame) -> DataFrame:
    return scores.join(vetoes.filter("vetoed").select("symbol", "date"), ["symbol", "date"], "left_anti")


def veto_rate(scores: DataFrame, vetoes: DataFrame) -> DataFrame:
    """One row: scored candidates, vetoed ones among them, and their share."""
    flags = scores.join(vetoes.select("symbol", "date", "vetoed"), ["symbol", "date"], "left")
    hit = F.count_if(F.coalesce("vetoed", F.lit(False)))
    return flags.agg(F.count("*").alias("scored"), hit.alias("vetoed"), (hit / F.greatest(F.count("*"), F.lit(1))).alias("rate"))


def alpha_tilt(scores: DataFrame, forecasts: DataFrame, value: str, weight: float) -> DataFrame:
    """Add the forecast's z-score, taken over all forecast symbols of the date; no forecast adds 0."""
    z = zscore(forecasts.filter(F.col(value).isNotNull()).select("symbol", "date", value), value, out="_z").drop(value)
    tilted = F.col("score") + weight * F.coalesce("_z", F.lit(0.0))
    return scores.join(z, ["symbol", "date"], "left").withColumn("score", tilted).drop("_z")


def rule_counts(judged: DataFrame) -> DataFrame:
    return judged.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("dropped"))
