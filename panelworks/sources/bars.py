"""Price bars, positions and extra series from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelworks.functions.scalar import clean as scalar_clean
from panelworks.operators.panel import FIELDS, Panel, densify


def normalize_bars(raw: DataFrame) -> DataFrame:
    """Columns matched by name regardless of case and blanks; all five fields are required; timestamps
    become dates."""
    names = {c: c.strip().lower() for c in raw.columns}
    clean = raw.withColumnsRenamed(names)
    missing = [f for f in FIELDS if f not in clean.columns]
    if missing:
        raise ValueError(f"bars lack {missing}")
    return clean.select(
        "symbol", F.to_date("date").alias("date"), *[scalar_clean(F.col(f).try_cast("double")).alias(f) for f in FIELDS]
    )


def assemble_panel(bars: DataFrame, symbols: DataFrame | None = None) -> Panel:
    """Dense panel over the union of all symbols' dates."""
    sessions = bars.select("date").distinct()
    return densify(bars, sessions, bars.select("symbol").distinct() if symbols is None else symbols)


def load_positions(spark: SparkSession, path: str) -> DataFrame:
    """Positions file: shares summed by symbol, blanks and zero positions dropped."""
    return positions(spark.read.option("header", True).csv(path))


def positions(raw: DataFrame) -> DataFrame:
    clean = raw.withColumnsRenamed({c: c.strip().lower() for c in raw.columns})
    if "symbol" not in clean.columns:
        raise ValueError("positions need a symbol column")
    shares = scalar_clean(F.col("shares").try_cast("double")) if "shares" in clean.columns else F.lit(0.0)
    return (
        clean.select(F.trim(F.upper("symbol")).alias("symbol"), F.coalesce(shares, F.lit(0.0)).alias("shares"))
        .filter("symbol != ''")
        .groupBy("symbol")
        .agg(F.sum("shares").alias("shares"))
        .filter("shares != 0")
    )


def extra_close(series: DataFrame, sessions: DataFrame) -> DataFrame:
    """A side series (date, close) put on the sessions by exact date and carried forward."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    on_days = sessions.join(series.select("date", "close"), "date", "left")
    return on_days.select("date", F.last("close", ignorenulls=True).over(w).alias("close"))


def symbol_close(panel: Panel, symbol: str) -> DataFrame:
    """Benchmark that is part of the panel: its close as it is, gaps included."""
    return panel.prices.filter(F.col("symbol") == symbol).select("date", "close")
