"""The dense price panel and the alignment operators on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.functions.windows import ordered, running

FIELDS = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class Panel:
    """``prices`` holds exactly one row per (symbol, session); a missing bar is a row of NULLs."""

    prices: DataFrame
    sessions: DataFrame
    symbols: DataFrame

    def grid(self) -> DataFrame:
        return grid(self.symbols, self.sessions)

    def subset(self, symbols: DataFrame) -> "Panel":
        """Keep the listed symbols that exist."""
        kept = self.symbols.join(symbols.select("symbol"), "symbol", "left_semi")
        return Panel(self.prices.join(symbols.select("symbol"), "symbol", "left_semi"), self.sessions, kept)


def grid(keys: DataFrame, sessions: DataFrame) -> DataFrame:
    """keys x sessions. Sessions are the broadcast side: their number is bounded by the calendar."""
    return keys.crossJoin(F.broadcast(sessions.select("date")))


def densify(bars: DataFrame, sessions: DataFrame, symbols: DataFrame) -> Panel:
    """Place bars, unique per (symbol, date), on the session grid.

    Only the bars and one head row per symbol are shuffled, by symbol. Each row then spawns the empty
    rows up to its successor in place, so the grid itself never crosses the network and the result is
    already partitioned for the per-symbol windows that follow.
    """
    everything = Window.orderBy("date")
    slots = sessions.select(
        "date",
        F.row_number().over(everything).alias("_slot"),
        F.count("*").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"),
    )
    slots = F.broadcast(slots)
    placed = bars.join(slots, "date").select("symbol", "_slot", "_n", *FIELDS)
    heads = symbols.select("symbol", F.lit(0).alias("_slot")).crossJoin(F.broadcast(sessions.agg(F.count("*").alias("_n"))))
    rows = placed.unionByName(heads, allowMissingColumns=True)
    following = F.lead("_slot").over(Window.partitionBy("symbol").orderBy("_slot"))
    spawned = rows.withColumn("_last", F.coalesce(following - 1, F.col("_n"))).select(
        "symbol", "_slot", *FIELDS, F.explode(F.sequence("_slot", F.col("_last").cast("int"))).alias("_at")
    )
    own = F.col("_at") == F.col("_slot")
    prices = (
        spawned.filter("_at > 0")
        .select("symbol", F.col("_at").alias("_slot"), *[F.when(own, F.col(f)).alias(f) for f in FIELDS])
        .join(slots, "_slot")
        .select("symbol", "date", *FIELDS)
    )
    return Panel(prices, sessions.select("date"), symbols.select("symbol"))


def bin_label(timeframe: str, day: str = "date") -> Column:
    """Closing label of a date's bin: the week's Friday or the month's last day."""
    if timeframe == "weekly":
        return F.date_add(day, F.pmod(F.lit(6) - F.dayofweek(day), F.lit(7)))
    if timeframe == "monthly":
        return F.last_day(day)
    raise ValueError(f"unsupported signal timeframe: {timeframe}")


def bin_labels(sessions: DataFrame, timeframe: str) -> DataFrame:
    """All labels between the first and last session's bins, empty bins included."""
    bounds = sessions.agg(
        F.min(bin_label(timeframe)).alias("lo"), F.max(bin_label(timeframe)).alias("hi")
    )
    if timeframe == "weekly":
        return bounds.select(F.explode(F.expr("sequence(lo, hi, interval 7 days)")).alias("date"))
    months = F.expr("sequence(trunc(lo, 'month'), hi, interval 1 month)")
    return bounds.select(F.explode(months).alias("m")).select(F.last_day("m").alias("date"))


def resample(panel: Panel, timeframe: str) -> Panel:
    """Open first, high max, low min, close last (first and last skip NULLs), volume sum with 0 for an
    empty bin. Bins without any session appear as well."""
    timeframe = timeframe.lower()
    if timeframe == "daily":
        return panel
    labels = bin_labels(panel.sessions, timeframe)
    blank = grid(panel.symbols, labels).withColumn("label", F.col("date"))
    rows = panel.prices.withColumn("label", bin_label(timeframe)).unionByName(blank, allowMissingColumns=True)

    def seen(field: str) -> Column:
        return F.when(F.col(field).isNotNull(), F.col("date"))

    prices = rows.groupBy("symbol", F.col("label").alias("date")).agg(
        F.min_by("open", seen("open")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", seen("close")).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
    )
    return Panel(prices, labels, panel.symbols)


def asof(
    targets: DataFrame,
    events: DataFrame,
    columns: Sequence[str],
    key: str = "symbol",
    carry: str = "value",
) -> DataFrame:
    """Backward as-of join on ``date`` per ``key``, as union + window instead of a range join.

    ``carry='value'`` takes the last non-null value of every column on its own; ``carry='row'`` takes
    the last event row as a whole, NULLs included. ``events`` is unique per (key, date), so a partition
    holds at most one event per calendar day of its key plus the targets.
    """
    own = [c for c in targets.columns if c not in (key, "date")]
    rows = events.select(key, "date", F.lit(0).alias("_kind"), F.struct(*columns).alias("_event")).unionByName(
        targets.withColumn("_kind", F.lit(1)), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    if carry == "value":
        picked = [F.last(F.col("_event")[c], ignorenulls=True).over(w).alias(c) for c in columns]
        found = rows.select(key, "date", "_kind", *own, *picked)
    elif carry == "row":
        found = rows.withColumn("_event", F.last("_event", ignorenulls=True).over(w)).select(
            key, "date", "_kind", *own, *[F.col("_event")[c].alias(c) for c in columns]
        )
    else:
        raise ValueError(f"unknown carry mode: {carry}")
    return found.filter("_kind = 1").drop("_kind")


def align(
    events: DataFrame, sessions: DataFrame, keys: DataFrame, columns: Sequence[str], carry: str = "value"
) -> DataFrame:
    """As-of onto every session of every key; events dated on a weekend show at the next session."""
    return asof(grid(keys, sessions), events, columns, keys.columns[0], carry)


def lag_for_open(frame: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Shift by one session: at the open, only the previous session's values are known."""
    kept = [c for c in frame.columns if c not in columns]
    return frame.select(*kept, *[F.lag(c).over(ordered(keys)).alias(c) for c in columns])


def log_returns(prices: DataFrame, field: str = "close", out: str = "logret") -> DataFrame:
    value = F.greatest(F.col(field), F.lit(1.0)) if field == "volume" else F.col(field)
    # greatest() skips NULLs, a missing volume has to stay missing
    value = F.when(F.col(field).isNotNull(), F.ln(value))
    return prices.withColumn(out, value - F.lag(value).over(ordered()))


def trade_prices(prices: DataFrame) -> DataFrame:
    """Price an order can be filled or marked at: the field itself, else the last close so far, which
    includes the same day's close."""
    last_close = F.last("close", ignorenulls=True).over(running())
    return prices.select(
        "symbol",
        "date",
        F.coalesce(F.col("open"), last_close).alias("open_px"),
        last_close.alias("close_px"),
    )


def forward_open_returns(prices: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Open of the next rebalance over the open of this one; NULL on the last."""
    at = prices.join(F.broadcast(rebalances.select("date")), "date", "left_semi")
    nxt = F.lead("open").over(ordered())
    return at.select("symbol", "date", (F.try_divide(nxt, F.col("open")) - 1).alias("forward_return"))


def at_prior_end(frame: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of ``frame`` at each date's ``prior_end``, stamped with the date. ``dates`` is the
    rebalance calendar with columns (date, prior_end)."""
    stamped = dates.select(F.col("prior_end").alias("date"), F.col("date").alias("_at"))
    return (
        frame.join(F.broadcast(stamped), "date")
        .withColumn("prior_end", F.col("date"))
        .withColumn("date", F.col("_at"))
        .drop("_at")
    )
