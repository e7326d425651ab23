"""Fundamental factors from quarterly and annual statements, as known after the filing lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelworks.settings import FUNDAMENTAL
from panelworks.functions.scalar import first_float, ratio
from panelworks.operators.panel import align, asof
from panelworks.sources.statements import LABELS

ITEMS = tuple(LABELS)


def item_views(chosen: DataFrame) -> DataFrame:
    """Per observed value: the value itself, the sum of four quarters, and the change on the year.

    Rows are a symbol's reporting periods; windows count observations, so NULL values are dropped first.
    """
    series = Window.partitionBy("symbol", "freq", "item").orderBy("period_end")
    four = series.rowsBetween(-3, 0)
    quarterly = F.col("freq") == "quarterly"
    prior = F.when(quarterly, F.lag("value", 4).over(series)).otherwise(F.lag("value", 1).over(series))
    return chosen.filter("value is not null").select(
        "symbol",
        "freq",
        "item",
        "period_end",
        "value",
        F.when(quarterly & (F.count("value").over(four) == 4), F.sum("value").over(four)).alias("ttm"),
        (ratio("value", prior) - 1).alias("yoy"),
    )


def item_snapshots(chosen: DataFrame, dates: DataFrame) -> DataFrame:
    """(symbol, period_end) with ``<item>_latest``, ``<item>_ttm`` and ``<item>_yoy`` as of each
    statement date. Every statement date is itself a row, so the as-of look-up is a running last value."""
    views = item_views(chosen)
    cells = []
    for item in ITEMS:
        for freq, tag in (("quarterly", "q"), ("annual", "a")):
            here = (F.col("item") == item) & (F.col("freq") == freq)
            cells.append(F.max(F.when(here, F.struct("value", "ttm", "yoy"))).alias(f"{tag}_{item}"))
    rows = dates.select("symbol", "period_end").distinct().unionByName(views, allowMissingColumns=True)
    wide = rows.groupBy("symbol", "period_end").agg(*cells)
    known = Window.partitionBy("symbol").orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    carried = wide.select(
        "symbol",
        "period_end",
        *[F.last(f"{t}_{i}", ignorenulls=True).over(known).alias(f"{t}_{i}") for i in ITEMS for t in ("q", "a")],
    )
    out = []
    for i in ITEMS:
        q, a = F.col(f"q_{i}"), F.col(f"a_{i}")
        out.append(F.coalesce(q["value"], a["value"]).alias(f"{i}_latest"))
        out.append(F.coalesce(q["ttm"], a["value"]).alias(f"{i}_ttm"))
        out.append(F.coalesce(q["yoy"], a["yoy"]).alias(f"{i}_yoy"))
    return carried.select("symbol", "period_end", *out)


def with_market_value(snapshots: DataFrame, prices: DataFrame, info: DataFrame, lag_days: int) -> DataFrame:
    """Availability date, last close by then (records without one are dropped) and market value."""
    dated = snapshots.withColumn("date", F.date_add("period_end", lag_days))
    closes = prices.filter("close is not null").select("symbol", "date", F.col("close").alias("price"))
    priced = asof(dated, closes, ["price"]).filter("price is not null")
    shares = info.select(
        "symbol", first_float("info", ["sharesOutstanding", "impliedSharesOutstanding"]).alias("shares")
    )
    return priced.join(shares, "symbol", "left").withColumn("market_cap", F.col("price") * F.col("shares"))


def with_surprise(snapshots: DataFrame, earnings: DataFrame) -> DataFrame:
    """Last earnings surprise at or before the *statement* date."""
    known = earnings.filter("surprise is not null").select(
        "symbol", "date", F.col("surprise").alias("earnings_surprise")
    )
    at = snapshots.withColumn("date", F.col("period_end"))
    return asof(at, known, ["earnings_surprise"]).drop("date")


def fundamental_ratios(records: DataFrame, names: Sequence[str] = FUNDAMENTAL) -> DataFrame:
    """The factor columns. A zero denominator gives NULL."""
    c = F.col
    formulas = {
        "book_to_market": ratio("equity_latest", "market_cap"),
        "earnings_yield": ratio("net_income_ttm", "market_cap"),
        "roa": ratio("net_income_ttm", "assets_latest"),
        "roe": ratio("net_income_ttm", "equity_latest"),
        "gross_profitability": ratio("gross_profit_ttm", "assets_latest"),
        "asset_growth": -c("assets_yoy"),
        "investment_to_assets": -ratio(F.abs("capex_ttm"), "assets_latest"),
        "net_issuance": -ratio(c("issuance_ttm") + c("repurchase_ttm"), "assets_latest"),
        "accruals": -ratio(c("net_income_ttm") - c("operating_cash_flow_ttm"), "assets_latest"),
        "cash_flow_yield": ratio("operating_cash_flow_ttm", "market_cap"),
        "earnings_surprise": c("earnings_surprise"),
    }
    return records.select("symbol", "date", "period_end", *[formulas[n].alias(n) for n in names])


def fundamental_records(
    chosen: DataFrame,
    dates: DataFrame,
    prices: DataFrame,
    info: DataFrame,
    earnings: DataFrame,
    lag_days: int,
    names: Sequence[str] = FUNDAMENTAL,
) -> DataFrame:
    """Factor values per availability date; the latest statement wins a shared date."""
    snapshots = item_snapshots(chosen, dates)
    if "earnings_surprise" in names:
        snapshots = with_surprise(snapshots, earnings)
    records = fundamental_ratios(with_market_value(snapshots, prices, info, lag_days), names)
    last = Window.partitionBy("symbol", "date").orderBy(F.col("period_end").desc())
    return records.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn", "period_end")


def fundamental_factors(records: DataFrame, sessions: DataFrame, symbols: DataFrame, names: Sequence[str]) -> DataFrame:
    """On sessions: values persist until replaced, each factor on its own."""
    return align(records, sessions, symbols, list(names))
