"""Whole studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.catalog import metrics, portfolio, sizing, sweeps, walk_forward  # noqa: F401  (table expressions)
from panelworks.catalog.base import r4
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.plans import factor_plan as plan
from panelworks.plans.backtest import StudyParams, run_study
from panelworks.sources import market

PARAMS = StudyParams(
    max_holdings=2,
    veto_threshold=0.75,
    trailing_vol_window=63,
    weight_tilt=0.17,
    conf_tilt_pow=2.0,
    vol_tilt_window=21,
    vol_tilt_pow=4.0,
    regime_sma=100,
    cost_per_side=portfolio.COST,
    start="1997-06-01",
)

cte(
    "st_base",
    """SELECT s.date, s.symbol, s.score FROM wf_scores s JOIN target_counts t ON t.date = s.date WHERE t.n > 0 AND s.date >= DATE '1997-06-01'""",
    ("wf_scores", "target_counts"),
)
cte(
    "st_kept",
    """SELECT s.* FROM st_base s LEFT JOIN weekly_ratios_m r ON r.symbol = s.symbol AND r.date = s.date WHERE NOT coalesce(r.ratio < 0.75, FALSE)""",
    ("st_base", "weekly_ratios_m"),
)
cte(
    "weekly_ratios_m",
    f"""SELECT v.symbol, w.date, l.level / nullif(v.tv, 0) AS ratio FROM rebal_prior w JOIN {sizing.TV} v ON v.date = w.prior_end
    ASOF LEFT JOIN (SELECT DISTINCT date AS made FROM levels) d ON d.made <= w.date
    LEFT JOIN levels l ON l.symbol = v.symbol AND l.date = d.made""",
    ("rebal_prior", "panel", "levels"),
)
GAPS = """SELECT date, gap FROM (SELECT date, abs(score - lead(score) OVER w) AS gap, row_number() OVER w AS rn FROM {t}
    WINDOW w AS (PARTITION BY date ORDER BY score DESC, symbol)) WHERE rn = 1"""
cte(
    "st_weights",
    f"""SELECT t.date, t.rank, t.symbol, r.scale * CASE WHEN n < 2 OR eff <= 0 THEN w WHEN t.rank = 1 THEN least(1, w + eff) ELSE greatest(0, w - eff / (n - 1)) END AS weight FROM (
    SELECT k.*, count(*) OVER (PARTITION BY k.date) AS n, CASE WHEN count(*) OVER (PARTITION BY k.date) > 1 THEN inv / sum(inv) OVER (PARTITION BY k.date) ELSE 1 END AS w,
    coalesce(least(1, least(0.17, 0.17 * pow(g.gap / m.med, 2)) * f.vf), 0) AS eff FROM (SELECT s.*, CASE WHEN v.vol IS NULL THEN 1000 ELSE 1 / greatest(v.vol, 0.001) END AS inv
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS INTEGER) AS rank FROM st_kept) s
    LEFT JOIN prior_vol v ON v.symbol = s.symbol AND v.date = s.date WHERE s.rank <= 2) k LEFT JOIN ({GAPS.format(t='st_kept')}) g ON g.date = k.date
    LEFT JOIN vol_factor f ON f.date = k.date CROSS JOIN (SELECT median(gap) AS med FROM ({GAPS.format(t='st_base')})) m) t JOIN regime r ON r.date = t.date""",
    ("st_kept", "st_base", "prior_vol", "vol_factor", "regime"),
)
cte(
    "st_targets",
    """SELECT 'base' AS run_id, date, rank, symbol, weight FROM st_weights UNION ALL SELECT DISTINCT 'base', date, NULL::INTEGER, NULL::VARCHAR, NULL::DOUBLE
    FROM st_base WHERE date NOT IN (SELECT date FROM st_kept)""",
    ("st_weights", "st_base", "st_kept"),
)
portfolio.valuation_ctes("sv", "st_targets", portfolio.COST, True, True)


def study(spark, sf_dir, by: str = "brand", noisy_runs=None, config=walk_forward.CONFIG):
    ctx = walk_forward.context(spark, sf_dir, by)
    state = plan.build_factor_state(ctx, config)
    bench = market.benchmark(ctx.panel.prices)
    return run_study(ctx, state, config, sizing.levels(ctx.panel), bench, PARAMS, noisy_runs, 0.3)


@query(
    "plan_study_targets",
    check_sql("SELECT run_id, date, rank, symbol, round(weight, 6) AS weight FROM st_targets", "st_targets"),
)
def study_targets(spark, sf_dir):
    return r4(study(spark, sf_dir).targets, "weight", digits=6)


@query(
    "plan_study_equity",
    check_sql("SELECT run_id, date, round(ln(equity), 8) AS log_equity FROM sv_equity WHERE date >= DATE '1997-06-01'", "sv_equity"),
)
def study_equity(spark, sf_dir):
    return study(spark, sf_dir).equity.select("run_id", "date", F.round(F.ln("equity"), 8).alias("log_equity"))
