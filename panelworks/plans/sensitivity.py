"""Many settings of one study as rows: what settings share is computed once, and variants join the pieces.

A variant's settings fall apart into sub-settings: the lookbacks of each factor, the eligibility rules, the fitting of
weights, the selection, the veto and the cost. Each piece of work is keyed by a hash of the sub-settings it depends on,
so factor columns, ranks, coefficients, weights and scores grow with distinct sub-settings and not with variants.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, is_dataclass, replace
from hashlib import sha1

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.functions.scalar import clean
from panelworks.operators import calendar as cal
from panelworks.operators import metrics as mt
from panelworks.operators import portfolio as pf
from panelworks.operators import walkforward as wf
from panelworks.operators.eligibility import mask_versions
from panelworks.operators.fundamentals import fundamental_factors
from panelworks.operators.indicators import factor_versions
from panelworks.operators.panel import forward_open_returns, lag_for_open, trade_prices
from panelworks.operators.scoring import ZERO
from panelworks.operators.sizing import equal_within
from panelworks.operators.stage import materialize
from panelworks.operators.xsection import rank_columns, top_n
from panelworks.plans.factor_plan import MarketContext
from panelworks.settings import FUNDAMENTAL, TECHNICAL, Lookbacks, Setup


@dataclass(frozen=True)
class Variant:
    """One column of a sweep: a study's settings, the ratio below which a name is vetoed, and the cost per side."""

    setup: Setup
    veto: float
    cost: float


#: The lookbacks that each technical factor reads.
READS = {
    "sma_crossover": ("averages",),
    "trend_filter": ("trend",),
    "ema_crossover": ("exponential",),
    "macd": ("convergence",),
    "rsi": ("strength",),
    "cci": ("channel",),
    "obv": ("volume_balance",),
    "bollinger": ("bands",),
    "breakout": ("breakout_weeks",),
    "variable_week_high": ("high_weeks",),
    "ts_momentum": ("momentum_months",),
    "price_action": ("action_weeks",),
}


def moved(settings: object, path: str, value: object) -> object:
    """``settings`` with the value at a dotted path replaced; numbers in a path index tuples."""
    head, _, rest = path.partition(".")
    if isinstance(settings, tuple):
        at = int(head)
        return (*settings[:at], moved(settings[at], rest, value) if rest else value, *settings[at + 1 :])
    if is_dataclass(settings):
        return replace(settings, **{head: moved(getattr(settings, head), rest, value) if rest else value})
    return {**settings, head: value}


def one_step(base: Variant, steps: Mapping[str, tuple[str, Sequence[object]]]) -> dict[str, Variant]:
    """``base`` and, for each family in ``steps`` (name: path and values), one variant per value."""
    out = {"base": base}
    for family, (path, values) in steps.items():
        out |= {f"{family}={value}": moved(base, path, value) for value in values}
    return out


def key_of(*parts: object) -> str:
    """Ten hex digits for sub-settings; equal ones share them."""
    return sha1(repr(parts).encode()).hexdigest()[:10]


def _used(factor: str, p: Lookbacks) -> Lookbacks:
    """Default lookbacks but for those that ``factor`` reads."""
    return replace(Lookbacks(), **{name: getattr(p, name) for name in READS[factor]})


@dataclass(frozen=True)
class Pieces:
    """The distinct sub-settings of some variants, and which of them each variant uses."""

    factors: dict[str, tuple[str, Lookbacks]]
    masks: dict[str, object]
    weights: dict[str, tuple[dict[str, str], object]]
    scores: dict[str, tuple[str, str]]
    of_variant: dict[str, str]


def pieces(variants: Mapping[str, Variant]) -> Pieces:
    factors: dict = {}
    masks: dict = {}
    weights: dict = {}
    scores: dict = {}
    of_variant: dict = {}
    for name, variant in variants.items():
        setup = variant.setup
        columns = {}
        for factor in setup.chosen(TECHNICAL + FUNDAMENTAL):
            column = factor
            if factor in TECHNICAL:
                column = f"{factor}_{key_of(_used(factor, setup.lookbacks))}"
                factors[column] = (factor, _used(factor, setup.lookbacks))
            columns[factor] = column
        weight = key_of(sorted(columns.items()), sorted(setup.fitting.given.items()), replace(setup.fitting, given={}))
        mask, score = f"mask_{key_of(setup.eligible)}", None
        score = key_of(weight, mask, setup.selection.positive_only)
        masks[mask] = setup.eligible
        weights[weight] = (columns, setup.fitting)
        scores[score] = (weight, mask, setup.selection.positive_only)
        of_variant[name] = score
    return Pieces(factors, masks, weights, scores, of_variant)


def weight_versions(coefficients: DataFrame, weights: Mapping[str, tuple[dict[str, str], object]]) -> DataFrame:
    """(weight_key, split_id, column, weight) for every way of fitting, from the coefficients per factor column.

    Grouped schemes with given weights first, as in ``walkforward.grouped_weights``; shares and given weights are
    columns of a small table of parameters, so all ways are fitted in one plan.
    """
    rows = []
    for key, (columns, fitting) in weights.items():
        if fitting.scheme not in ("ic", "equal", "grouped_ic", "grouped_equal"):
            raise ValueError(f"unsupported weighting scheme: {fitting.scheme}")
        grouped, groups = fitting.scheme.startswith("grouped"), {factor in FUNDAMENTAL for factor in columns}
        for factor, column in columns.items():
            fundamental = grouped and factor in FUNDAMENTAL
            share = min(1.0, max(0.0, float(fitting.fundamental_share)))
            share = 1.0 if not grouped or len(groups) == 1 else share if fundamental else 1.0 - share
            given = max(0.0, float(fitting.given.get(factor, 0.0))) if fundamental else 0.0
            rows.append((key, column, fundamental, share, given, fitting.scheme.endswith("ic")))
    schema = "weight_key string, column string, fundamental boolean, share double, given double, by_ic boolean"
    params = coefficients.sparkSession.createDataFrame(rows, schema)
    joined = coefficients.withColumnRenamed("factor", "column").join(F.broadcast(params), "column")
    group = Window.partitionBy("weight_key", "split_id", "fundamental")
    size, given = F.sum(F.abs("ic")).over(group), F.sum("given").over(group)
    equal = F.lit(1.0) / F.count("*").over(group)
    fitted = F.when(~F.col("by_ic") | (size == 0), equal).otherwise(F.try_divide("ic", size))
    local = F.when(given > 0, F.try_divide("given", given)).otherwise(fitted)
    return joined.select("weight_key", "split_id", "column", (local * F.col("share")).alias("weight"))


def score_versions(ctx: MarketContext, variants: Mapping[str, Variant]) -> tuple[DataFrame, Pieces]:
    """(score_key, symbol, date, score) of every distinct scoring among the variants, on all test dates.

    Variants share the rebalance calendar, the signal's granularity and the split windows of the first one; a variant
    that differs there is an error, as is one that needs the trend filter in its mask.
    """
    found = pieces(variants)
    first = next(iter(variants.values())).setup
    w = first.fitting
    same = ("train_months", "test_months", "step_months", "least_dates", "least_symbols")
    for name, variant in variants.items():
        s = variant.setup
        if (s.rebalance, s.signal, s.needs_trend) != (first.rebalance, first.signal, False) or any(
            getattr(s.fitting, f) != getattr(w, f) for f in same
        ):
            raise ValueError(f"variant {name} has another calendar, windows or a trend filter")
    p = ctx.panel
    at = cal.rebalance_sessions(p.sessions, first.rebalance)
    known = lag_for_open(factor_versions(p, found.factors, first.signal), list(found.factors))
    known = known.join(F.broadcast(at.select("date")), "date", "left_semi")
    filed = sorted({c for columns, _ in found.weights.values() for c in columns.values()} - set(found.factors))
    if filed:
        rows = lag_for_open(fundamental_factors(ctx.fundamentals, p.sessions, p.symbols, filed), filed)
        known = known.join(rows.join(F.broadcast(at.select("date")), "date", "left_semi"), ["symbol", "date"], "left")
    columns = [*found.factors, *filed]
    ranks = materialize(rank_columns(materialize(known, "known_versions"), columns), "rank_versions")
    splits = wf.build_splits(at, w)
    train = wf.strip_leaky(wf.train_dates(splits, at))
    ic = wf.information_coefficients(ranks, forward_open_returns(p.prices, at), columns, w.least_symbols)
    fitted = materialize(weight_versions(wf.split_scores(ic, train, splits, columns), found.weights), "weight_versions")
    # One row per way of fitting and split, small as the calendar; each date has the rows of the split that owns it.
    cells = [F.coalesce(F.max(F.when(F.col("column") == c, F.col("weight"))), F.lit(0.0)).alias(f"w_{c}") for c in columns]
    wide = fitted.groupBy("weight_key", "split_id").agg(*cells)
    dated = wf.assign_test_dates(splits, at).join(wide, "split_id").drop("split_id")
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0.0)) * F.col(f"w_{c}")
    raw = ranks.join(dated, "date").select("weight_key", "symbol", "date", clean(total).alias("score"))
    masks = mask_versions(p.prices, ctx.membership, found.masks).join(F.broadcast(at.select("date")), "date", "left_semi")
    used = [(key, weight, mask, positive) for key, (weight, mask, positive) in found.scores.items()]
    pairs = p.prices.sparkSession.createDataFrame(used, "score_key string, weight_key string, mask string, positive boolean")
    allowed = masks.unpivot(["symbol", "date"], list(found.masks), "mask", "eligible").where("eligible")
    scored = raw.join(F.broadcast(pairs), "weight_key").join(allowed, ["symbol", "date", "mask"])
    kept = scored.where(F.col("score").isNotNull() & (~F.col("positive") | (F.col("score") > ZERO)))
    return materialize(kept.select("score_key", "symbol", "date", "score"), "score_versions"), found


def _names(macro: Column) -> Column:
    """``scoring.target_holdings`` with the selection's numbers in columns."""
    graded = F.when(macro <= F.col("half_at"), F.greatest(F.lit(1), F.floor(F.col("names") / 2))).otherwise(F.col("names"))
    return F.when(macro.isNull(), F.col("names")).when(macro <= F.col("none_at"), 0).otherwise(graded).cast("int")


def variant_targets(ctx: MarketContext, variants: Mapping[str, Variant], ratios: DataFrame) -> DataFrame:
    """(run_id, date, rank, symbol, weight, cost) of every variant; ``ratios`` (symbol, date, ratio) decide vetoes."""
    scores, found = score_versions(ctx, variants)
    rows = []
    for name, v in variants.items():
        s = v.setup.selection
        none_at = None if s.none_at is None else float(s.none_at)
        rows.append((name, found.of_variant[name], s.names, float(s.half_at), none_at, float(v.veto), float(v.cost)))
    schema = "run_id string, score_key string, names int, half_at double, none_at double, veto double, cost double"
    params = scores.sparkSession.createDataFrame(rows, schema)
    judged = scores.join(ratios, ["symbol", "date"], "left").join(
        F.broadcast(ctx.macro.select("date", "macro_score")), "date", "left"
    )
    each = judged.join(F.broadcast(params), "score_key").where(~F.coalesce(F.col("ratio") < F.col("veto"), F.lit(False)))
    counted = each.withColumn("n", _names(F.col("macro_score"))).where("n > 0")
    most = max(v.setup.selection.names for v in variants.values())
    best = top_n(counted, F.col("n"), ["run_id", "date"], at_most=most)
    return equal_within(best, ["run_id", "date"]).select("run_id", "date", "rank", "symbol", "weight", "cost")


def sensitivity(
    ctx: MarketContext, variants: Mapping[str, Variant], ratios: DataFrame, bench: DataFrame, capital: float
) -> DataFrame:
    """Metrics of each variant with its worst year, all valued in one job."""
    px = materialize(trade_prices(ctx.panel.prices), "px")
    v = pf.value(variant_targets(ctx, variants, ratios), px, "cost", capital)
    equity = materialize(pf.equity_curve(v, px, ctx.panel.sessions, capital), "equity")
    years = mt.summarize_years(mt.year_metrics(equity, bench))
    return mt.extended_metrics(equity, bench).join(years, "run_id")
