"""From market data to weighted scores for every rebalance date, in one job over all dates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from panelworks.operators import calendar as cal
from panelworks.operators import walkforward as wf
from panelworks.operators.eligibility import base_mask
from panelworks.operators.fundamentals import fundamental_factors
from panelworks.operators.indicators import technical_factors
from panelworks.operators.panel import Panel, forward_open_returns, lag_for_open
from panelworks.operators.scoring import clean_scores, composite, risk_on, select_targets
from panelworks.operators.stage import materialize
from panelworks.operators.xsection import rank_columns
from panelworks.settings import FUNDAMENTAL, TECHNICAL, Setup


@dataclass(frozen=True)
class MarketContext:
    """Inputs of an analysis. ``macro`` is (date, macro_score), already known at the open;
    ``fundamentals`` holds factor records by availability date."""

    panel: Panel
    membership: DataFrame
    macro: DataFrame
    fundamentals: DataFrame | None = None
    holdings: DataFrame | None = None


@dataclass(frozen=True)
class FactorState:
    """Everything scoring needs, at the decision dates only."""

    factors: list[str]
    ranks: DataFrame
    mask: DataFrame
    macro: DataFrame
    rebalances: DataFrame
    splits: DataFrame
    weights: DataFrame
    assignment: DataFrame
    coefficients: DataFrame


def ranked_factors(ctx: MarketContext, config: Setup, at: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Lagged factor ranks and the eligibility mask on the dates ``at``. Values are cut down to those
    dates right after the lag, so only decision dates are shuffled for ranking, and the result is stored
    because coefficients, scores and sweeps all read it."""
    technical = config.chosen(TECHNICAL)
    fundamental = config.chosen(FUNDAMENTAL) if ctx.fundamentals is not None else []
    trend = ["trend_filter", "sma_crossover"] if config.needs_trend else []
    computed = list(dict.fromkeys(technical + trend))
    p = ctx.panel
    known = lag_for_open(
        technical_factors(p, config.lookbacks, config.signal, computed), computed
    ).join(F.broadcast(at.select("date")), "date", "left_semi")
    if fundamental:
        filed = lag_for_open(fundamental_factors(ctx.fundamentals, p.sessions, p.symbols, fundamental), fundamental)
        filed = filed.join(F.broadcast(at.select("date")), "date", "left_semi")
        known = known.join(filed, ["symbol", "date"], "left")
    factors = technical + fundamental
    known = materialize(known, "known_factors")
    ranks = materialize(rank_columns(known, factors), "factor_ranks")
    flags = known.select("symbol", "date", *trend) if trend else None
    mask = base_mask(p.prices, ctx.membership, config.eligible, flags)
    mask = mask.join(F.broadcast(at.select("date")), "date", "left_semi")
    return ranks, mask, factors


def build_factor_state(ctx: MarketContext, config: Setup) -> FactorState:
    w = config.fitting
    rebalances = cal.rebalance_sessions(ctx.panel.sessions, config.rebalance)
    ranks, mask, factors = ranked_factors(ctx, config, rebalances)
    splits = wf.build_splits(rebalances, w)
    clean_train = wf.strip_leaky(wf.train_dates(splits, rebalances))
    forward = forward_open_returns(ctx.panel.prices, rebalances)
    ic = wf.information_coefficients(ranks, forward, factors, w.least_symbols)
    scores = wf.split_scores(ic, clean_train, splits, factors)
    weights = wf.fit_weights(scores, w)
    return FactorState(
        factors=factors,
        ranks=ranks,
        mask=mask,
        macro=ctx.macro,
        rebalances=rebalances,
        splits=splits,
        weights=weights,
        assignment=wf.assign_test_dates(splits, rebalances),
        coefficients=scores,
    )


def scored(state: FactorState, config: Setup, override=None, extra=None, ranks: DataFrame | None = None) -> DataFrame:
    """(symbol, date, score) of the eligible symbols on all test dates, before any selection."""
    wide = wf.weights_wide(state.weights, state.factors)
    raw = composite(state.ranks if ranks is None else ranks, wide, state.assignment, state.factors, override, extra)
    return clean_scores(raw, state.mask, config.selection.positive_only).select("symbol", "date", "score")


def walk_forward_plan(state: FactorState, config: Setup) -> DataFrame:
    """(date, rank, symbol, score): the selection of every test date."""
    return select_targets(scored(state, config), state.macro, config.selection)


def composite_scores(state: FactorState, config: Setup, override=None, extra=None, ranks=None) -> DataFrame:
    """The harness path: all scored names, dates with a flat macro score left out."""
    return risk_on(scored(state, config, override, extra, ranks), state.macro, config.selection)


def split_diagnostics(state: FactorState) -> DataFrame:
    """Bounds of each split, how many test dates it owns, and its weights as a map."""
    owned = state.assignment.groupBy("split_id").agg(F.count("*").alias("test_dates"))
    weights = state.weights.groupBy("split_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("factor", "weight")))).alias("weights")
    )
    bounds = state.splits.select("split_id", "train_start", "train_end", "test_start", "test_end")
    return bounds.join(owned, "split_id", "left").join(weights, "split_id", "left").fillna(0, ["test_dates"])


def live_session(sessions: DataFrame, as_of: date) -> date:
    """First session at or after the date, else the last one loaded."""
    row = sessions.agg(
        F.min(F.when(F.col("date") >= F.lit(as_of), F.col("date"))).alias("next"), F.max("date").alias("last")
    ).first()
    return row["next"] or row["last"]


def live_screen(ctx: MarketContext, config: Setup, as_of: date) -> DataFrame:
    """Selection for one arbitrary session: weights are fitted on the training window that ends there,
    names, sectors and fund weights are attached."""
    spark = ctx.panel.prices.sparkSession
    session = live_session(ctx.panel.sessions, as_of)
    rebalances = cal.rebalance_sessions(ctx.panel.sessions, config.rebalance)
    today = spark.createDataFrame([(session,)], "date date")
    ranks, mask, factors = ranked_factors(ctx, config, rebalances.union(today).distinct())
    split = today.select(
        F.lit(0).alias("split_id"),
        F.add_months("date", -config.fitting.train_months).alias("train_lo"),
        F.col("date").alias("test_start"),
    )
    clean_train = wf.strip_leaky(wf.train_dates(split, rebalances))
    forward = forward_open_returns(ctx.panel.prices, rebalances)
    ic = wf.information_coefficients(ranks, forward, factors, config.fitting.least_symbols)
    weights = wf.fit_weights(wf.split_scores(ic, clean_train, split, factors), config.fitting)
    state = FactorState(
        factors=factors,
        ranks=ranks,
        mask=mask,
        macro=ctx.macro,
        rebalances=rebalances,
        splits=split,
        weights=weights,
        assignment=today.withColumn("split_id", F.lit(0)),
        coefficients=ic,
    )
    picks = walk_forward_plan(state, config)
    if ctx.holdings is not None:
        meta = ctx.holdings.select(
            F.col("ticker").alias("symbol"), "name", "sector", F.col("weight_pct").alias("etf_weight_pct")
        )
        picks = picks.join(meta, "symbol", "left")
    macro = ctx.macro.select("date", F.col("macro_score").alias("macro_composite"))
    return picks.join(F.broadcast(macro), "date", "left")
