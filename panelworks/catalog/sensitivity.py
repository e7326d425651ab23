"""The structural sensitivity sweep: thirteen families of one-step changes, in Spark and in the check SQL."""

from __future__ import annotations

from dataclasses import replace

from panelworks.catalog import metrics, portfolio, sizing, tables, walk_forward
from panelworks.catalog.base import r4
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.operators import sweeps as sw
from panelworks.plans import sensitivity as sv
from panelworks.settings import Selection
from panelworks.sources import market

FACTORS = ("sma_crossover", "trend_filter", "ts_momentum", "asset_growth", "earnings_yield")
BASE = sv.Variant(
    setup=replace(
        walk_forward.CONFIG,
        factors=FACTORS,
        lookbacks=replace(tables.PARAMS, momentum_months=(9, 1)),
        selection=Selection(names=2, half_at=-0.3, none_at=-0.6),
        fitting=replace(walk_forward.WF, given={"asset_growth": 2.0, "earnings_yield": 1.0}),
    ),
    veto=0.9,
    cost=0.001,
)
STEPS = {
    "veto_threshold": ("veto", (0.85, 0.95)),
    "macro_half": ("setup.selection.half_at", (-0.2, -0.4)),
    "macro_flat": ("setup.selection.none_at", (-0.5, -0.7)),
    "max_holdings": ("setup.selection.names", (1, 3)),
    "cost": ("cost", (0.0005, 0.002)),
    "sma_fast": ("setup.lookbacks.averages.0", (8, 12)),
    "sma_slow": ("setup.lookbacks.averages.1", (25, 35)),
    "sma_trend": ("setup.lookbacks.trend", (55, 65)),
    "ts_mom": ("setup.lookbacks.momentum_months.0", (8, 10)),
    "fund_group_w": ("setup.fitting.fundamental_share", (0.2, 0.3)),
    "asset_growth": ("setup.fitting.given.asset_growth", (1.0, 4.0)),
    "earnings_yield": ("setup.fitting.given.earnings_yield", (0.5, 2.0)),
    "min_volume": ("setup.eligible.dollar_volume", (50_000.0, 70_000.0)),
}
VARIANTS = sv.one_step(BASE, STEPS)


def _columns(v: sv.Variant) -> dict[str, str]:
    look = v.setup.lookbacks
    return {
        "sma_crossover": f"sma_{look.averages[0]}_{look.averages[1]}",
        "trend_filter": f"trend_{look.trend}",
        "ts_momentum": f"mom_{look.momentum_months[0]}",
        "asset_growth": "asset_growth",
        "earnings_yield": "earnings_yield",
    }


def _technical_sql() -> str:
    """Every version of every technical factor on the sessions."""
    look = [v.setup.lookbacks for v in VARIANTS.values()]
    spans = sorted({n for p in look for n in (*p.averages, p.trend)})
    mean = "CASE WHEN count(close) OVER w{n} >= {need} THEN avg(close) OVER w{n} END AS m{n}"
    means = ", ".join(mean.format(n=n, need=max(2, n // 2)) for n in spans)
    frames = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)" for n in spans)
    crossed = {(p.averages): f"(m{p.averages[0]} - m{p.averages[1]}) / nullif(m{p.averages[1]}, 0) AS sma_{p.averages[0]}_{p.averages[1]}" for p in look}
    above = {p.trend: f"(close - m{p.trend}) / nullif(m{p.trend}, 0) AS trend_{p.trend}" for p in look}
    return f"SELECT symbol, date, {', '.join([*crossed.values(), *above.values()])} FROM (SELECT symbol, date, close, {means} FROM panel WINDOW {frames})"


TECHNICAL = sorted({c for v in VARIANTS.values() for c in list(_columns(v).values())[:2]})
MOMENTUM = sorted({v.setup.lookbacks.momentum_months[0] for v in VARIANTS.values()})
COLUMNS = [*TECHNICAL, *(f"mom_{n}" for n in MOMENTUM), "asset_growth", "earnings_yield"]
cte("sn_technical", _technical_sql(), ("panel",))
cte(
    "sn_values",
    f"""SELECT t.*, {', '.join(f'm{n}.v AS mom_{n}' for n in MOMENTUM)}, f.asset_growth, f.earnings_yield FROM sn_technical t
    JOIN fund_factors f ON f.symbol = t.symbol AND f.date = t.date """
    + " ".join(
        f"""ASOF LEFT JOIN (SELECT * FROM (SELECT symbol, date, lag(close, 1) OVER w / nullif(lag(close, {n}) OVER w, 0) - 1 AS v FROM monthly
        WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE v IS NOT NULL) m{n} ON m{n}.symbol = t.symbol AND m{n}.date <= t.date"""
        for n in MOMENTUM
    ),
    ("sn_technical", "fund_factors", "monthly"),
)
cte(
    "sn_known",
    f"""SELECT symbol, date, {', '.join(f'lag({c}) OVER w AS {c}' for c in COLUMNS)} FROM (SELECT symbol, date,
    {', '.join(f'last_value({c} IGNORE NULLS) OVER u AS {c}' for c in COLUMNS)} FROM sn_values
    WINDOW u AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    ("sn_values",),
)
cte(
    "sn_ranks",
    f"SELECT symbol, date, {', '.join(f'{tables.rank_sql(c)} AS {c}' for c in COLUMNS)} FROM sn_known WHERE date IN (SELECT date FROM rebal)",
    ("sn_known", "rebal"),
)
cte("sn_long", f"SELECT * FROM (UNPIVOT sn_ranks ON {', '.join(COLUMNS)} INTO NAME col VALUE x)", ("sn_ranks",))
cte(
    "sn_ic",
    f"""SELECT s.split_id, c.col, coalesce(avg(i.ic), 0) AS ic FROM splits s CROSS JOIN (SELECT unnest({COLUMNS!r}) AS col) c
    LEFT JOIN clean_train t ON t.split_id = s.split_id LEFT JOIN (SELECT col, date, corr(rx, ry) AS ic FROM (SELECT col, date,
    {tables.rank_sql('x', 'col, date', '')} AS rx, {tables.rank_sql('y', 'col, date', '')} AS ry FROM (SELECT l.col, l.date, l.x, f.forward_return AS y
    FROM sn_long l JOIN forward f ON f.symbol = l.symbol AND f.date = l.date WHERE f.forward_return IS NOT NULL)) GROUP BY 1, 2
    HAVING count(*) >= 8 AND NOT isnan(corr(rx, ry))) i ON i.col = c.col AND i.date = t.date GROUP BY 1, 2""",
    ("splits", "clean_train", "sn_long", "forward"),
)


def _params() -> str:
    rows = []
    for name, v in VARIANTS.items():
        fit = v.setup.fitting
        for factor, column in _columns(v).items():
            fund = factor in tables.FUND
            share = fit.fundamental_share if fund else 1 - fit.fundamental_share
            rows.append(f"('{name}', '{column}', {fund}, CAST({share} AS DOUBLE), CAST({fit.given[factor] if fund else 0.0} AS DOUBLE))")
    return ", ".join(rows)


cte(
    "sn_weights",
    f"""SELECT run_id, split_id, col, share * CASE WHEN sum(given) OVER g > 0 THEN given / sum(given) OVER g
    WHEN sum(abs(ic)) OVER g = 0 THEN 1.0 / count(*) OVER g ELSE ic / sum(abs(ic)) OVER g END AS weight
    FROM sn_ic JOIN (VALUES {_params()}) p(run_id, col, fund, share, given) USING (col) WINDOW g AS (PARTITION BY run_id, split_id, fund)""",
    ("sn_ic",),
)
VOLUMES = sorted({v.setup.eligible.dollar_volume for v in VARIANTS.values()})
cte(
    "sn_mask",
    f"""SELECT p.symbol, p.date, volume FROM (SELECT symbol, date, coalesce(lag(h >= 60) OVER w, FALSE) AND coalesce(lag(close >= 500) OVER w, FALSE) AS ok,
    lag(adv, 2) OVER w AS adv FROM (SELECT symbol, date, close, count(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS h,
    CASE WHEN count(close * volume) OVER v >= 10 THEN avg(close * volume) OVER v END AS adv FROM panel
    WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)) WINDOW w AS (PARTITION BY symbol ORDER BY date)) p
    JOIN membership m ON m.symbol = p.symbol AND m.date = p.date, (SELECT unnest({VOLUMES!r}) AS volume) WHERE ok AND adv >= volume
    AND p.date IN (SELECT date FROM rebal)""",
    ("panel", "membership", "rebal"),
)
_CHOICES = ", ".join(
    f"('{name}', {v.setup.selection.names}, CAST({v.setup.selection.half_at} AS DOUBLE), CAST({v.setup.selection.none_at} AS DOUBLE), "
    f"CAST({v.veto} AS DOUBLE), CAST({v.cost} AS DOUBLE), CAST({v.setup.eligible.dollar_volume} AS DOUBLE))"
    for name, v in VARIANTS.items()
)
cte(
    "sn_targets",
    f"""SELECT run_id, date, CAST(rank AS INTEGER) AS rank, symbol, 1.0 / count(*) OVER (PARTITION BY run_id, date) AS weight, cost FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, date ORDER BY score DESC, symbol) AS rank FROM (SELECT s.*, c.cost,
    CASE WHEN k.macro_score IS NULL THEN c.names WHEN k.macro_score <= c.none_at THEN 0 WHEN k.macro_score <= c.half_at THEN greatest(1, c.names // 2)
    ELSE c.names END AS n FROM (SELECT w.run_id, l.symbol, l.date, sum(coalesce(l.x, 0) * w.weight) AS score FROM sn_long l
    JOIN assignment a ON a.date = l.date JOIN sn_weights w ON w.split_id = a.split_id AND w.col = l.col GROUP BY 1, 2, 3) s
    JOIN (VALUES {_CHOICES}) c(run_id, names, half_at, none_at, veto, cost, volume) USING (run_id)
    JOIN sn_mask m ON m.symbol = s.symbol AND m.date = s.date AND m.volume = c.volume
    LEFT JOIN macro_known k ON k.date = s.date LEFT JOIN ratios r ON r.symbol = s.symbol AND r.date = s.date
    WHERE s.score > 1e-9 AND NOT coalesce(r.ratio < c.veto, FALSE))) WHERE rank <= n""",
    ("sn_long", "assignment", "sn_weights", "sn_mask", "macro_known", "ratios"),
)
portfolio.valuation_ctes("sn", "sn_targets", "cost", True, True)
metrics.extended_sql("sn_run", "sn_equity", "run_id", ("sn_equity",))
cte("sn_years", "SELECT *, year(date) AS year FROM sn_equity", ("sn_equity",))
metrics.extended_sql("sn_year", "sn_years", "run_id, year", ("sn_years",))
cte(
    "sn_metrics",
    """SELECT run_id, r.sharpe, r.cagr, y.worst_year_sharpe FROM sn_run r JOIN (SELECT run_id, min(sharpe) AS worst_year_sharpe FROM sn_year
    GROUP BY run_id) y USING (run_id)""",
    ("sn_run", "sn_year"),
)


def _metrics(spark, sf_dir):
    ctx = walk_forward.context(spark, sf_dir)
    found = sv.sensitivity(ctx, VARIANTS, sizing.ratios(ctx.panel), market.benchmark(ctx.panel.prices), portfolio.CAPITAL)
    return found.select("run_id", "sharpe", "cagr", "worst_year_sharpe")


@query(
    "sw_02_structural_sensitivity",
    check_sql(
        """SELECT run_id, split_part(run_id, '=', 1) AS family, round(sharpe, 4) AS sharpe, round(asinh(cagr), 4) AS cagr,
        round(worst_year_sharpe, 4) AS worst_year_sharpe FROM sn_metrics""",
        "sn_metrics",
    ),
)
def structural_sensitivity(spark, sf_dir):
    rows = metrics.scaled(_metrics(spark, sf_dir), ("sharpe", "cagr", "worst_year_sharpe"))
    return rows.selectExpr("run_id", "split_part(run_id, '=', 1) AS family", "sharpe", "cagr", "worst_year_sharpe")


@query(
    "sw_02_structural_spread",
    check_sql(
        """SELECT round(max(worst_year_sharpe) - min(worst_year_sharpe), 4) AS worst_spread, round(max(sharpe) - min(sharpe), 4) AS sharpe_spread,
        round(CASE WHEN max(sharpe) > 0 THEN (max(sharpe) - min(sharpe)) / max(sharpe) END, 4) AS sharpe_collapse,
        coalesce(max(worst_year_sharpe) - min(worst_year_sharpe) < 0.5 AND (max(sharpe) - min(sharpe)) / max(sharpe) < 0.3, FALSE) AS passed
        FROM sn_metrics""",
        "sn_metrics",
    ),
)
def structural_spread(spark, sf_dir):
    return r4(sw.sensitivity_spread(_metrics(spark, sf_dir)), "worst_spread", "sharpe_spread", "sharpe_collapse")
