"""Composite scores, target counts and the clean-up before selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelworks.settings import Selection
from panelworks.functions.scalar import clean
from panelworks.operators.xsection import top_n

# Positive and negative ranks that cancel leave about 1e-17 instead of 0.
ZERO = 1e-9


def clean_scores(scores: DataFrame, mask: DataFrame, require_positive: bool) -> DataFrame:
    """Eligible symbols with a finite score, positive if asked for."""
    ok = mask.filter("eligible").select("symbol", "date")
    kept = scores.join(ok, ["symbol", "date"], "left_semi").withColumn("score", clean("score"))
    return kept.filter(F.col("score") > ZERO) if require_positive else kept.filter("score is not null")


def target_holdings(macro: Column | str, s: Selection) -> Column:
    """How many names to hold given the macro score: all, half, or none when cash is allowed."""
    macro = F.col(macro) if isinstance(macro, str) else macro
    full, half = F.lit(s.names), F.lit(max(1, s.names // 2))
    graded = F.when(macro <= s.half_at, half).otherwise(full)
    if s.none_at is not None:
        graded = F.when(macro <= s.none_at, F.lit(0)).otherwise(graded)
    return F.when(macro.isNull(), full).otherwise(graded)


def composite(
    ranks: DataFrame,
    weights: DataFrame,
    assignment: DataFrame,
    factors: Sequence[str],
    override: Mapping[str, str] | None = None,
    extra: Mapping[str, float] | None = None,
) -> DataFrame:
    """(symbol, date, split_id, score): sum of weight x rank with missing ranks as 0.

    ``weights`` has one row per split with a ``w_<factor>`` column, ``assignment`` maps dates to splits;
    both are calendar-sized and broadcast, so the factor table is not shuffled. ``override`` swaps the
    rank column of a factor, ``extra`` adds rank columns with a fixed weight.
    """
    swap = dict(override or {})
    dated = F.broadcast(assignment.join(weights, "split_id"))
    total = F.lit(0.0)
    for f in factors:
        total = total + F.coalesce(F.col(swap.get(f, f)), F.lit(0.0)) * F.coalesce(F.col(f"w_{f}"), F.lit(0.0))
    for name, weight in (extra or {}).items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * F.lit(weight)
    return ranks.join(dated, "date").select("symbol", "date", "split_id", total.alias("score"))


def select_targets(scores: DataFrame, macro: DataFrame, s: Selection) -> DataFrame:
    """Best names per date, as many as the macro score of that date allows: (date, rank, symbol, score)."""
    counts = macro.select("date", target_holdings("macro_score", s).alias("n"))
    with_count = scores.join(F.broadcast(counts), "date", "left").withColumn("n", F.coalesce("n", F.lit(s.names)))
    return top_n(with_count.filter("n > 0"), F.col("n"), at_most=s.names).select("date", "rank", "symbol", "score")


def risk_on(scores: DataFrame, macro: DataFrame, s: Selection) -> DataFrame:
    """The other scoring path: the whole list of names, except that a flat macro score empties the date.
    The half-risk count plays no role here."""
    flat = macro.filter(target_holdings("macro_score", s) == 0).select("date")
    return scores.join(F.broadcast(flat), "date", "left_anti")
