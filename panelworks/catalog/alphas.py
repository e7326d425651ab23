"""The yearly choice among blends of composite and forecast, over vetoed and valued portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.catalog import portfolio, walk_forward
from panelworks.catalog.metrics import scaled, scaled_sql
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.operators import metrics as mt
from panelworks.operators import portfolio as pf
from panelworks.operators.panel import trade_prices
from panelworks.operators.sizing import equal_within
from panelworks.operators.stage import materialize
from panelworks.sources import market

portfolio.valuation_ctes("al", "alpha_targets", portfolio.COST, True, True)
cte(
    "alpha_days",
    """SELECT CAST(e.run_id AS DOUBLE) AS alpha, CAST(year(e.date) AS INTEGER) AS year, e.date, e.equity FROM al_equity e
    JOIN (SELECT run_id, min(date) AS opened FROM alpha_targets GROUP BY 1) t ON t.run_id = e.run_id AND e.date >= t.opened""",
    ("al_equity", "alpha_targets"),
)
EXCESS = "ret - 0.05 / 252"
RATED = f"""sqrt(252) * avg({EXCESS}) / nullif(stddev_samp({EXCESS}), 0) AS sharpe, count(ret) AS n,
    pow(arg_max(equity, date) / arg_min(equity, date), 365.25 / greatest(1, max(date) - min(date))) - 1 AS cagr, min(fall) AS max_drawdown"""
cte(
    "alpha_years",
    f"""SELECT alpha, year, {RATED} FROM (SELECT *, equity / lag(equity) OVER w - 1 AS ret, equity / max(equity) OVER w - 1 AS fall
    FROM alpha_days WINDOW w AS (PARTITION BY alpha, year ORDER BY date)) GROUP BY 1, 2""",
    ("alpha_days",),
)
# Every prefix replayed from its first day.
cte(
    "alpha_priors",
    f"""SELECT alpha, before AS year, {RATED} FROM (SELECT *, equity / lag(equity) OVER w - 1 AS ret, equity / max(equity) OVER w - 1 AS fall
    FROM alpha_days JOIN (SELECT DISTINCT year AS before FROM alpha_days) ON year < before WINDOW w AS (PARTITION BY alpha, before ORDER BY date))
    GROUP BY 1, 2""",
    ("alpha_days",),
)
METRICS = ("sharpe", "cagr", "max_drawdown", "calmar")


def alpha_curves(spark, sf_dir):
    """(alpha, date, equity) of one portfolio per alpha, from its first selection on; all are valued in one job."""
    p = market.stored_panel(spark, sf_dir)
    picks = equal_within(walk_forward.blend_picks(spark, sf_dir, p), ["alpha", "date"])
    targets = materialize(picks.select(F.col("alpha").cast("string").alias("run_id"), "date", "rank", "symbol", "weight"), "alpha_targets")
    px = materialize(trade_prices(p.prices), "px")
    curve = pf.equity_curve(pf.value(targets, px, portfolio.COST, portfolio.CAPITAL), px, p.sessions, portfolio.CAPITAL)
    opened = targets.groupBy("run_id").agg(F.min("date").alias("_opened"))
    held = curve.join(F.broadcast(opened), "run_id").where("date >= _opened")
    return materialize(held.select(F.col("run_id").cast("double").alias("alpha"), "date", "equity"), "alpha_curves")


@query(
    "wf_13_yearly_alpha",
    check_sql(
        f"""SELECT year, alpha, round(prior_sharpe, 4) AS prior_sharpe, round(sharpe, 4) AS oos_sharpe, round(asinh(cagr), 4) AS oos_cagr,
        round(max_drawdown, 4) AS oos_max_drawdown, round(asinh(calmar), 4) AS oos_calmar FROM (SELECT y.*, y.cagr / nullif(abs(y.max_drawdown), 0) AS calmar,
        p.sharpe AS prior_sharpe, row_number() OVER (PARTITION BY y.year ORDER BY p.sharpe DESC, y.alpha) AS rn
        FROM alpha_years y JOIN alpha_priors p ON p.alpha = y.alpha AND p.year = y.year WHERE p.sharpe IS NOT NULL AND p.n >= 2) WHERE rn = 1""",
        "alpha_years",
        "alpha_priors",
    ),
)
def yearly_alpha(spark, sf_dir):
    chosen = mt.choose_by_prior_sharpe(alpha_curves(spark, sf_dir), "alpha")
    shown = {f"oos_{m}": f"oos_{m}" for m in METRICS}
    grown = chosen.withColumns({c: F.asinh(c) for c in ("oos_cagr", "oos_calmar")})
    return scaled(grown.select("year", "alpha", "prior_sharpe", *shown), ("prior_sharpe", *shown))


@query(
    "wf_13_alpha_prefixes",
    check_sql(
        f"""SELECT alpha, year, {', '.join(scaled_sql(m) for m in METRICS)} FROM (SELECT *, cagr / nullif(abs(max_drawdown), 0) AS calmar
        FROM alpha_priors)""",
        "alpha_priors",
    ),
)
def alpha_prefixes(spark, sf_dir):
    """Metrics of every alpha on all dates before each year, from joined segments."""
    parts = mt.segments(alpha_curves(spark, sf_dir).withColumn("year", F.year("date")), ["alpha", "year"])
    before = mt.joined_before(parts, "alpha", "year").where("n IS NOT NULL")
    return scaled(mt.segment_metrics(before, ["alpha", "year"]), METRICS)
