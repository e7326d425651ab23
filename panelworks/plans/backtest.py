"""The full study: scores, veto, sizing, overlays, valuation, metrics and noisy re-runs, as one graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from panelworks.operators import calendar as cal
from panelworks.operators import metrics as mt
from panelworks.operators import portfolio as pf
from panelworks.operators import sizing as sz
from panelworks.operators import veto as vt
from panelworks.operators.eligibility import primary_window
from panelworks.operators.panel import trade_prices
from panelworks.operators.stage import materialize
from panelworks.plans.factor_plan import FactorState, MarketContext, composite_scores
from panelworks.settings import Setup


@dataclass(frozen=True)
class StudyParams:
    max_holdings: int = 2
    veto_threshold: float = 0.35
    relative_veto: float | None = None
    trailing_vol_window: int = 21
    vol_lookback: int | None = 21
    corr_threshold: float | None = None
    weight_tilt: float = 0.0
    conf_tilt_pow: float | None = None
    vol_tilt_window: int | None = None
    vol_tilt_cap: float = 2.0
    vol_tilt_pow: float = 1.0
    regime_sma: int | None = None
    regime_fraction: float = 0.5
    cost_per_side: float = 0.0003
    start: str = "2015-01-01"


def base_scores(state: FactorState, config: Setup, start: str) -> DataFrame:
    """Composite scores of the primary window, stored because veto, sizing and every noisy run read them."""
    return materialize(primary_window(composite_scores(state, config), start), "base_scores")


def vetoes(ctx: MarketContext, levels: DataFrame, dates: DataFrame, p: StudyParams) -> DataFrame:
    r = vt.volume_ratios(levels, ctx.panel.prices, dates, p.trailing_vol_window)
    return vt.relative_veto(r, p.relative_veto) if p.relative_veto is not None else vt.absolute_veto(r, p.veto_threshold)


def size(ctx: MarketContext, scores: DataFrame, base: DataFrame, bench: DataFrame, dates: DataFrame, p: StudyParams) -> DataFrame:
    """Targets per (run_id, date). ``base`` are the unperturbed scores, from which the usual gap is taken."""
    keys = ("run_id", "date")
    picks = sz.top_n_equal_weights(scores, p.max_holdings, keys)
    if p.vol_lookback is not None:
        picks = sz.inverse_vol_weights(picks, sz.prior_volatility(ctx.panel.prices, dates, p.vol_lookback), keys=keys)
    if p.weight_tilt > 0:
        eff = F.lit(p.weight_tilt)
        if p.conf_tilt_pow is not None:
            lead = sz.leader_gap(scores, keys).select(*keys, "gap").crossJoin(F.broadcast(sz.median_gap(base)))
            picks = picks.join(lead, list(keys), "left")
            factor = None
            if p.vol_tilt_window is not None:
                factors = sz.vol_factors(bench, dates, p.vol_tilt_window, p.vol_tilt_cap, p.vol_tilt_pow)
                picks = picks.join(F.broadcast(factors), "date", "left")
                factor = F.col("vol_factor")
            eff = F.coalesce(
                sz.confidence_tilt(F.col("gap"), p.weight_tilt, F.col("median_gap"), p.conf_tilt_pow, factor), F.lit(0.0)
            )
        picks = sz.tilt_to_leader(picks, eff, keys)
    if p.regime_sma is not None:
        picks = sz.apply_scale(picks, sz.regime_scale(bench, dates, p.regime_sma, p.regime_fraction))
    return picks.select("run_id", "date", "rank", "symbol", "weight")


@dataclass(frozen=True)
class Study:
    targets: DataFrame
    equity: DataFrame
    trades: DataFrame
    metrics: DataFrame
    years: DataFrame


def run_study(
    ctx: MarketContext,
    state: FactorState,
    config: Setup,
    levels: DataFrame,
    bench: DataFrame,
    p: StudyParams,
    noisy_runs: DataFrame | None = None,
    sigma: float = 0.03,
) -> Study:
    """Run ``base`` and, with ``noisy_runs(run_id)``, its perturbed copies; all are valued together.

    Dates whose scores were all vetoed go to cash; dates without scores hold what they have.
    """
    panel = ctx.panel
    dates = cal.previous_session(state.rebalances, panel.sessions)
    base = base_scores(state, config, p.start)
    runs = base.withColumn("run_id", F.lit("base")).select("run_id", "date", "symbol", "score")
    if noisy_runs is not None:
        runs = runs.unionByName(sz.perturb(base, noisy_runs, sigma))
    decided = runs.select("run_id", "date").distinct()
    kept = vt.apply_veto(runs, materialize(vetoes(ctx, levels, dates, p), "vetoes"))
    if p.corr_threshold is not None:
        kept = sz.diversify(kept, panel.prices, panel.sessions, p.corr_threshold, keys=("run_id", "date"))
    kept = materialize(kept, "kept_scores")
    targets = size(ctx, kept, base, bench, dates, p)
    emptied = decided.join(kept.select("run_id", "date").distinct(), ["run_id", "date"], "left_anti")
    targets = materialize(targets.unionByName(emptied, allowMissingColumns=True), "targets")
    px = trade_prices(panel.prices)
    capital = config.capital
    v = pf.value(targets, px, p.cost_per_side, capital)
    equity = materialize(pf.equity_curve(v, px, panel.sessions, capital, p.start), "equity")
    return Study(
        targets=targets,
        equity=equity,
        trades=pf.trades(v, px, panel.sessions, p.cost_per_side),
        metrics=mt.extended_metrics(equity, bench),
        years=mt.year_metrics(equity, bench),
    )
