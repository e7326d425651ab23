"""Position sizing on selected names, and the overlays that change names or weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.functions.scalar import ratio
from panelworks.functions.windows import Mean, padded_change, rolling, with_rolling_means
from panelworks.operators.panel import at_prior_end
from panelworks.operators.walkforward import pearson
from panelworks.operators.xsection import leader_gap, top_n

# Fixed value: volatilities are floored here, and a missing one is replaced by it, so that a name
# without history gets the largest inverse weight.
VOL_FLOOR = 0.001


def top_n_equal_weights(scores: DataFrame, n: int, keys=("date",)) -> DataFrame:
    """Best ``n`` names with weight 1 over the names found."""
    return equal_within(top_n(scores, n, keys), keys)


def prior_volatility(prices: DataFrame, dates: DataFrame, lookback: int, need: int = 10) -> DataFrame:
    """Sample deviation of padded daily returns over ``lookback`` sessions, as of each prior end."""
    returns = prices.select("symbol", "date", padded_change("close").alias("_ret"))
    vol = returns.select("symbol", "date", rolling("_ret", lookback, need, F.stddev_samp).alias("vol"))
    return at_prior_end(vol, dates).select("symbol", "date", "vol")


def inverse_vol_weights(picks: DataFrame, vols: DataFrame, missing: float = VOL_FLOOR, keys=("date",)) -> DataFrame:
    """Weights inverse to volatility wherever there is more than one name."""
    w = Window.partitionBy(*keys)
    known = picks.join(vols.select("symbol", "date", "vol"), ["symbol", "date"], "left")
    # greatest() skips NULLs: without a volatility the replacement has to be applied before the floor
    floored = 1.0 / F.greatest("vol", F.lit(VOL_FLOOR))
    inverse = F.when(F.col("vol").isNull(), F.lit(1.0 / missing)).otherwise(floored)
    known = known.withColumn("_inv", inverse)
    weight = F.when(F.count("*").over(w) > 1, F.col("_inv") / F.sum("_inv").over(w)).otherwise(F.lit(1.0))
    return known.withColumn("weight", weight).drop("_inv", "vol")


def confidence_tilt(gap: Column, tilt: float, median_gap: Column, power: float, vol_factor: Column | None = None) -> Column:
    """Share of weight to move to the leader: all of ``tilt`` for a clear lead, less for a close call."""
    eff = F.least(F.lit(tilt), tilt * F.pow(ratio(gap, median_gap), F.lit(power)))
    if vol_factor is not None:
        eff = F.least(F.lit(1.0), eff * F.coalesce(vol_factor, F.lit(1.0)))
    return F.when(median_gap > 0, eff).otherwise(F.lit(tilt))


def tilt_to_leader(picks: DataFrame, tilt: str | Column, keys=("date",)) -> DataFrame:
    """Move ``tilt`` from the other names, equally, to rank 1; weights stay within 0 and 1."""
    tilt = F.col(tilt) if isinstance(tilt, str) else tilt
    n = F.count("*").over(Window.partitionBy(*keys))
    up = F.least(F.lit(1.0), F.col("weight") + tilt)
    down = F.greatest(F.lit(0.0), F.col("weight") - tilt / F.nullif(n - 1, F.lit(0)))
    tilted = F.when(F.col("rank") == 1, up).otherwise(down)
    return picks.withColumn("weight", F.when((n >= 2) & (tilt > 0), tilted).otherwise(F.col("weight")))


def median_gap(scores: DataFrame, keys=("date",)) -> DataFrame:
    """One row: median over *all* dates of the lead of the best name. Uses the whole sample."""
    return leader_gap(scores, keys).filter("gap is not null").agg(F.median("gap").alias("median_gap"))


def expanding_median_gap(scores: DataFrame) -> DataFrame:
    """Per date, the median over the dates so far: the look-ahead-free alternative."""
    gaps = leader_gap(scores).filter("gap is not null").select("date", "gap")
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return gaps.select("date", F.percentile("gap", 0.5).over(so_far).alias("median_gap"))


def vol_factors(bench: DataFrame, dates: DataFrame, window: int, cap: float, power: float) -> DataFrame:
    """(date, vol_factor): benchmark volatility at the prior end over its median, raised and capped; 1
    where unknown. Benchmark and dates are one row per session."""
    one = bench.withColumn("_k", F.lit(0))
    change = one.select("_k", "date", padded_change("close", ["_k"]).alias("_ret"))
    vol = change.select("date", rolling("_ret", window, 5, F.stddev_samp, ["_k"]).alias("_vol"))
    at = at_prior_end(vol, dates).select("date", "_vol")
    usual = at.filter("_vol > 0").agg(F.median("_vol").alias("_median"))
    factor = F.least(F.lit(cap), F.pow(ratio("_vol", "_median"), F.lit(power)))
    known = (F.col("_vol") > 0) & (F.col("_median") > 0)
    return at.crossJoin(F.broadcast(usual)).select("date", F.when(known, factor).otherwise(F.lit(1.0)).alias("vol_factor"))


def correlation_windows(sessions: DataFrame, dates: DataFrame, length: int = 63) -> DataFrame:
    """(date, day) for the last ``length`` sessions before each date. Calendar-sized."""
    numbered = sessions.select(F.col("date").alias("day"), F.row_number().over(Window.orderBy("date")).alias("_i"))
    at = dates.select("date").join(numbered, F.col("date") == F.col("day")).select("date", F.col("_i").alias("_pos"))
    inside = (F.col("_i") < F.col("_pos")) & (F.col("_i") >= F.col("_pos") - length)
    return at.join(F.broadcast(numbered), inside).select("date", "day")


def diversify(
    scores: DataFrame,
    prices: DataFrame,
    sessions: DataFrame,
    threshold: float,
    length: int = 63,
    min_rows: int = 20,
    keys=("date",),
) -> DataFrame:
    """Leader plus the best name whose trailing return correlation to it is at most ``threshold``; a date
    without such a name is left as it is. Names without a defined correlation do not qualify."""
    keys = list(keys)
    returns = prices.select("symbol", F.col("date").alias("day"), padded_change("close").alias("ret"))
    leaders = leader_gap(scores, keys).select(*keys, F.col("top_symbol").alias("leader"))
    windows = correlation_windows(sessions, scores.select("date").distinct(), length)
    long_enough = windows.groupBy("date").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows).select("date")
    windows = windows.join(long_enough, "date", "left_semi")
    rows = scores.select(*keys, "symbol").join(F.broadcast(windows), "date").join(returns, ["symbol", "day"])
    lead = rows.join(leaders, keys).filter("symbol = leader").select(*keys, "day", F.col("ret").alias("lead_ret"))
    pairs = rows.join(lead, [*keys, "day"]).filter("ret is not null and lead_ret is not null")
    corr = pairs.groupBy(*keys, "symbol").agg(pearson("ret", "lead_ret").alias("corr"))
    led = scores.join(leaders, keys)
    calm = led.filter("symbol != leader").join(corr.filter(F.col("corr") <= threshold), [*keys, "symbol"])
    partner = top_n(calm, 1, keys).select(*keys, F.col("symbol").alias("partner"))
    out = led.join(partner, keys, "left")
    keep = F.col("partner").isNull() | (F.col("symbol") == F.col("leader")) | (F.col("symbol") == F.col("partner"))
    return out.filter(keep).select(*keys, "symbol", "score")


def regime_scale(bench: DataFrame, dates: DataFrame, window: int, fraction: float, need: int = 10) -> DataFrame:
    """(date, scale): ``fraction`` where the benchmark closed below its mean at the prior end, else 1."""
    one = with_rolling_means(bench.withColumn("_k", F.lit(0)), {"_mean": Mean("close", window, need)}, ["_k"])
    flags = one.select("date", (F.col("close") < F.col("_mean")).alias("_bear"))
    at = at_prior_end(flags, dates)
    return at.select("date", F.when(F.coalesce("_bear", F.lit(False)), F.lit(fraction)).otherwise(F.lit(1.0)).alias("scale"))


def apply_scale(targets: DataFrame, scale: DataFrame) -> DataFrame:
    out = targets.join(F.broadcast(scale), "date", "left")
    return out.withColumn("weight", F.col("weight") * F.coalesce("scale", F.lit(1.0))).drop("scale")


def _uniform(key: Column, start: int) -> Column:
    """52 bits of the key's MD5 as a number strictly between 0 and 1."""
    return (F.conv(F.substring(F.md5(key), start, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def standard_normal(*parts: Column | str) -> Column:
    """A normal draw that depends on the key only: the same on any partitioning and any engine."""
    key = F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.sqrt(-2 * F.ln(_uniform(key, 1))) * F.cos(2 * math.pi * _uniform(key, 14))


def perturb(scores: DataFrame, runs: DataFrame, sigma: float) -> DataFrame:
    """Every run's noisy copy of the scores: noise scales with the date's score spread (1 if there is
    none), and scores that turn non-positive are dropped."""
    spreads = scores.groupBy("date").agg(F.stddev_samp("score").alias("_spread"))
    scaled = scores.join(spreads, "date").withColumn("_scale", F.when(F.col("_spread") > 0, F.col("_spread")).otherwise(F.lit(1.0)))
    noisy = scaled.crossJoin(F.broadcast(runs.select("run_id")))
    draw = standard_normal("run_id", F.col("date").cast("string"), "symbol")
    noisy = noisy.withColumn("score", F.col("score") + sigma * F.col("_scale") * draw)
    return noisy.filter("score > 0").select("run_id", "date", "symbol", "score")


def equal_within(picks: DataFrame, keys=("date",)) -> DataFrame:
    """Equal weights over the names already picked."""
    return picks.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy(*keys)))
