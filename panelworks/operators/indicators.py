"""Technical factors on the resampled panel, aligned to sessions.

Each ``*_columns`` function returns window expressions over (symbol, date); expressions that share a
window specification are evaluated in one pass over one sort.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.settings import TECHNICAL, Lookbacks
from panelworks.functions.scalar import ratio
from panelworks.functions.windows import Mean, ordered, rolling, running, with_rolling_means
from panelworks.operators.ewm import Ewm, ewm_columns
from panelworks.operators.panel import Panel, grid, resample


def sma(prices: DataFrame, n: int, value: str = "close", out: str = "sma") -> DataFrame:
    """``prices`` with a simple moving average."""
    return with_rolling_means(prices, {out: Mean(value, n)})


def average_of(n: int) -> str:
    """The column in which ``technical_factors`` holds the mean close over ``n`` bars."""
    return f"_mean_close_{n}"


def sma_crossover(fast: int, slow: int) -> Column:
    return ratio(F.col(average_of(fast)) - F.col(average_of(slow)), average_of(slow))


def trend_filter(n: int) -> Column:
    return ratio(F.col("close") - F.col(average_of(n)), average_of(n))


def breakout(weeks: int) -> Column:
    """Distance of the close from the highest high; the window includes the current bar."""
    n = max(5, weeks)
    return ratio(F.col("close"), rolling("high", n, agg=F.max)) - 1


def bollinger(n: int, width: float) -> Column:
    return ratio(F.col("close") - F.col(average_of(n)), width * rolling("close", n, agg=F.stddev_samp))


def avg_dollar_volume(prices: DataFrame, n: int = 20, out: str = "avg_dollar_volume") -> DataFrame:
    """``prices`` with the mean of close times volume. The frame is short and added up by itself."""
    return prices.withColumn(out, rolling(F.col("close") * F.col("volume"), n))


def cci(frame: DataFrame, n: int, out: str = "cci") -> DataFrame:
    """Deviation is averaged against each row's own moving average, hence two stacked windows."""
    kept = frame.columns
    tp = frame.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    dev = with_rolling_means(tp, {"_tp_mean": Mean("_tp", n)}).withColumn("_gap", F.col("_tp") - F.col("_tp_mean"))
    spread = with_rolling_means(dev.withColumn("_size", F.abs("_gap")), {"_spread": Mean("_size", n)})
    return spread.select(*kept, (ratio("_gap", 0.015 * F.col("_spread")) / 200).alias(out))


def on_balance_volume(frame: DataFrame, out: str = "obv_level") -> DataFrame:
    kept = frame.columns
    step = F.signum(F.col("close") - F.lag("close").over(ordered()))
    signed = frame.withColumn("_signed", F.coalesce(step, F.lit(0.0)) * F.coalesce(F.col("volume"), F.lit(0.0)))
    return signed.select(*kept, F.sum("_signed").over(running()).alias(out))


def ewm_factors(signal: DataFrame, p: Lookbacks, names: set[str]) -> DataFrame:
    """The recursive factors, all from one grouped pass over the symbol's bars."""
    kept = signal.columns
    frame, specs, finals = signal, [], []
    if "ema_crossover" in names:
        specs += [Ewm.span(name, "close", n) for name, n in zip(("ema_fast", "ema_slow"), p.exponential)]
        finals.append(ratio(F.col("ema_fast") - F.col("ema_slow"), "ema_slow").alias("ema_crossover"))
    if "rsi" in names:
        delta = F.col("close") - F.lag("close").over(ordered())
        frame = frame.withColumn("_delta", delta)
        frame = frame.withColumn("_gain", F.when(F.col("_delta").isNotNull(), F.greatest("_delta", F.lit(0.0))))
        frame = frame.withColumn("_loss", F.when(F.col("_delta").isNotNull(), -F.least("_delta", F.lit(0.0))))
        alpha = 1.0 / p.strength
        specs += [Ewm("avg_gain", "_gain", alpha, p.strength), Ewm("avg_loss", "_loss", alpha, p.strength)]
        rsi = 100 - 100 / (1 + ratio("avg_gain", "avg_loss"))
        finals.append(((rsi - 50) / 50).alias("rsi"))
    if "macd" in names:
        specs += [
            Ewm.span("macd_fast", "close", p.convergence[0]),
            Ewm.span("macd_slow", "close", p.convergence[1]),
            Ewm.span("macd_signal", ("macd_fast", "macd_slow"), p.convergence[2]),
        ]
        histogram = F.col("macd_fast") - F.col("macd_slow") - F.col("macd_signal")
        finals.append(ratio(histogram, F.col("close")).alias("macd"))
    if "obv" in names:
        frame = on_balance_volume(frame).withColumn("_obv_size", F.abs("obv_level") + 1)
        specs += [Ewm.span("obv_mean", "obv_level", p.volume_balance), Ewm.span("obv_size", "_obv_size", p.volume_balance)]
        finals.append(ratio(F.col("obv_level") - F.col("obv_mean"), "obv_size").alias("obv"))
    carried = [*kept, "obv_level"] if "obv" in names else kept
    return ewm_columns(frame, specs, keep=carried).select(*kept, *finals)


def month_momentum(lookback: int, skip: int) -> Column:
    """Return between two past month-end closes, on the contiguous month grid."""
    recent = F.lag("close", skip).over(ordered()) if skip else F.col("close")
    return ratio(recent, F.lag("close", lookback).over(ordered())) - 1


def week_factors(weeks: DataFrame, p: Lookbacks) -> DataFrame:
    """Distance from several rolling highs, and the share of weeks that went up, made a higher high or
    a higher low. A change next to a missing bar counts as not up."""
    windows = p.high_weeks
    distances = [ratio(F.col("close"), rolling("close", n, agg=F.max)) - 1 for n in windows]
    total = distances[0]
    for d in distances[1:]:
        total = total + d

    def rose(field: str) -> Column:
        return F.coalesce(F.col(field) > F.lag(field).over(ordered()), F.lit(False)).cast("double")

    n = p.action_weeks
    flags = weeks.withColumns({f"_{f}_up": rose(f) for f in ("close", "high", "low")})
    shares = rolling("_close_up", n) + rolling("_high_up", n) + rolling("_low_up", n)
    return flags.select(
        "symbol",
        "date",
        (total / len(windows)).alias("variable_week_high"),
        (shares / 3 - 0.5).alias("price_action"),
    )



def technical_factors(
    panel: Panel, p: Lookbacks, timeframe: str = "daily", names: Iterable[str] = TECHNICAL
) -> DataFrame:
    """(symbol, date, one column per requested factor) on the session grid, not yet lagged."""
    wanted = set(names)
    return factor_versions(panel, {name: (name, p) for name in [*TECHNICAL, *wanted] if name in wanted}, timeframe)


def factor_versions(panel: Panel, versions: Mapping[str, tuple[str, Lookbacks]], timeframe: str = "daily") -> DataFrame:
    """(symbol, date, one column per version): each a technical factor with lookbacks of its own.

    Only what is asked for is computed, and what versions share is computed once: one resampling, one sort, one set of
    rolling sums. Signals of all granularities are unioned with the session grid and carried forward by one window; no
    joins.
    """
    unknown = {factor for factor, _ in versions.values()} - set(TECHNICAL)
    if unknown:
        raise ValueError(f"unknown technical factors: {sorted(unknown)}")
    timeframe = timeframe.lower()
    signal_panel = resample(panel, timeframe)
    signal = signal_panel.prices

    def of(*factors: str) -> dict[str, tuple[str, Lookbacks]]:
        return {version: (factor, p) for version, (factor, p) in versions.items() if factor in factors}

    recursive = of("ema_crossover", "rsi", "macd", "obv")
    for p in dict.fromkeys(p for _, p in recursive.values()):
        mine = {factor: version for version, (factor, q) in recursive.items() if q == p}
        signal = ewm_factors(signal, p, set(mine)).withColumnsRenamed(mine)
    for version, (_, p) in of("cci").items():
        signal = cci(signal, p.channel, version)
    spans = {n for _, p in of("sma_crossover").values() for n in p.averages}
    spans |= {p.trend for _, p in of("trend_filter").values()} | {p.bands[0] for _, p in of("bollinger").values()}
    if spans:
        signal = with_rolling_means(signal, {average_of(n): Mean("close", n) for n in sorted(spans)})
    direct = {
        "sma_crossover": lambda p: sma_crossover(*p.averages),
        "trend_filter": lambda p: trend_filter(p.trend),
        "breakout": lambda p: breakout(p.breakout_weeks),
        "bollinger": lambda p: bollinger(*p.bands),
    }
    made = {v: direct[factor](p).alias(v) if factor in direct else F.col(v) for v, (factor, p) in of(*direct, "cci").items()}
    on_signal = [v for v in versions if v in made or v in recursive]
    signal = signal.select("symbol", "date", *[made.get(v, F.col(v)) for v in on_signal])
    coarse = []
    momentum = of("ts_momentum")
    if momentum:
        months = resample(signal_panel, "monthly").prices
        coarse.append(months.select("symbol", "date", *[month_momentum(*p.momentum_months).alias(v) for v, (_, p) in momentum.items()]))
    weekly = of("variable_week_high", "price_action")
    if weekly:
        weeks = resample(signal_panel, "weekly").prices
        for p in dict.fromkeys(p for _, p in weekly.values()):
            mine = {factor: version for version, (factor, q) in weekly.items() if q == p}
            coarse.append(week_factors(weeks, p).select("symbol", "date", *mine).withColumnsRenamed(mine))
    return _carry_to_sessions(panel, signal, on_signal, coarse, timeframe == "daily")


def _carry_to_sessions(
    panel: Panel, signal: DataFrame, on_signal: list[str], coarse: list[DataFrame], daily: bool
) -> DataFrame:
    """Week and month bins reach the signal rows as whole rows (NULLs included); signal rows reach the
    sessions value by value. Kinds order rows that share a date: bin, signal, session."""
    w = Window.partitionBy("symbol").orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    if daily and not coarse:
        return signal.select("symbol", "date", *[F.last(c, True).over(running()).alias(c) for c in on_signal])
    rows = signal.withColumn("_kind", F.lit(1))
    packed = {}
    for i, events in enumerate(coarse):
        values = [c for c in events.columns if c not in ("symbol", "date")]
        packed[f"_bin{i}"] = values
        part = events.select("symbol", "date", F.lit(0).alias("_kind"), F.struct(*values).alias(f"_bin{i}"))
        rows = rows.unionByName(part, allowMissingColumns=True)
    if not daily:
        blank = grid(panel.symbols, panel.sessions).withColumn("_kind", F.lit(2))
        rows = rows.unionByName(blank, allowMissingColumns=True)
    seen = rows.select(
        "symbol", "date", "_kind", *on_signal, *[F.last(b, True).over(w).alias(b) for b in packed]
    )
    at_signal = F.col("_kind") == 1
    values = list(on_signal)
    seen = seen.select(
        "symbol",
        "date",
        "_kind",
        *on_signal,
        *[F.when(at_signal, F.col(b)[c]).alias(c) for b, cols in packed.items() for c in cols],
    )
    values += [c for cols in packed.values() for c in cols]
    carried = seen.select("symbol", "date", "_kind", *[F.last(c, True).over(w).alias(c) for c in values])
    return carried.filter(F.col("_kind") == (1 if daily else 2)).drop("_kind")
