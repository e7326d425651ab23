"""Flagship query: weekly trend, ranked across symbols and traded at each month's first session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.operators.calendar import rebalance_sessions
from panelworks.operators.indicators import technical_factors
from panelworks.operators.panel import Panel, lag_for_open
from panelworks.operators.xsection import cross_sectional_rank, top_n
from panelworks.settings import Lookbacks
from panelworks.sources import market


def pick_trends(panel: Panel, weeks: int = 40, n: int = 2) -> DataFrame:
    """(date, rank, symbol, score) of the ``n`` symbols with the highest lagged weekly trend."""
    params = Lookbacks(trend=weeks)
    trend = technical_factors(panel, params, "weekly", ["trend_filter"])
    known = lag_for_open(trend, ["trend_filter"])
    monthly = rebalance_sessions(panel.sessions, "monthly")
    at = known.join(F.broadcast(monthly), "date", "left_semi")
    scored = at.withColumn("score", cross_sectional_rank("trend_filter")).filter(F.col("score").isNotNull())
    return top_n(scored, n).select("date", "rank", "symbol", F.round("score", 4).alias("score"))


def trend_picks(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    return pick_trends(market.panel(spark, sf_dir, by))
