"""Cross-sectional operators: per-date ranks, scores, cut-offs and picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.operators.stage import materialize

Keys = Sequence[str]


def pct_rank(value: Column | str, keys: Keys = ("date",)) -> Column:
    """Percentile rank in (0, 1], ties averaged, NULLs excluded, as an expression: one cross-section is one window
    partition. Rank and tie count share one sort: the peers of a row are the RANGE frame from the current row to itself.
    ``wide_pct_rank`` gives the same numbers without holding a cross-section together."""
    value = F.col(value) if isinstance(value, str) else value
    by = Window.partitionBy(*keys).orderBy(value.asc_nulls_last())
    peers = by.rangeBetween(Window.currentRow, Window.currentRow)
    everyone = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    average = F.rank().over(by) + (F.count(value).over(peers) - 1) / 2
    return F.when(value.isNotNull(), average / F.count(value).over(everyone))


def cross_sectional_rank(value: Column | str, keys: Keys = ("date",)) -> Column:
    return pct_rank(value, keys) - 0.5


def counted_values(frame: DataFrame, value: str, keys: Keys = ("date",)) -> DataFrame:
    """``keys, value`` with ``_below`` and ``_peers``: how many values of the cross-section are smaller and equal, and
    ``_all``: how many there are.

    Ties are folded first, then distinct values are range-partitioned over the whole cluster and stored,
    so that partition numbers are stable; each slice is ranked on its own and shifted by the number of
    values in the slices before it. No task ever holds a whole date.
    """
    named = frame.filter(F.col(value).isNotNull())
    folded = named.groupBy(*keys, value).agg(F.count("*").alias("_peers"))
    slices = materialize(
        folded.repartitionByRange(*keys, value).withColumn("_slice", F.spark_partition_id()), "rank_slices"
    )
    sizes = slices.groupBy(*keys, "_slice").agg(F.sum("_peers").alias("_size"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    offsets = sizes.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_size").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("_all"),
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(value)
    below = F.coalesce(F.sum("_peers").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = slices.withColumn("_inside", below).join(offsets, [*keys, "_slice"])
    return joined.select(*keys, value, (F.col("_before") + F.col("_inside")).alias("_below"), "_peers", "_all")


def wide_pct_rank(frame: DataFrame, value: str, keys: Keys = ("date",), out: str = "rank") -> DataFrame:
    """``pct_rank`` for cross-sections of any size, as a column ``out``."""
    counted = counted_values(frame, value, keys)
    rank = (F.col("_below") + (F.col("_peers") + 1) / 2) / F.col("_all")
    return frame.join(counted.select(*keys, value, rank.alias(out)), [*keys, value], "left")


def rank_columns(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(symbol, date, centred rank per column), all columns ranked together over the cluster."""
    long = frame.unpivot(["symbol", "date"], list(columns), "_column", "_value")
    ranked = wide_pct_rank(long, "_value", ("_column", "date"), "_rank")
    cells = [F.max(F.when(F.col("_column") == c, F.col("_rank") - 0.5)).alias(c) for c in columns]
    return ranked.groupBy("symbol", "date").agg(*cells)


def zscore(frame: DataFrame, value: str, keys: Keys = ("date",), out: str = "z") -> DataFrame:
    """Sample z-score per cross-section as a column ``out``; 0 when the spread is 0, NULL stays NULL. Mean and spread
    are aggregated before they meet the rows."""
    stats = frame.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_spread"))
    z = (F.col(value) - F.col("_mean")) / F.nullif(F.col("_spread"), F.lit(0.0))
    scored = F.when(F.col(value).isNotNull(), F.coalesce(z, F.lit(0.0)))
    return frame.join(stats, list(keys), "left").withColumn(out, scored).drop("_mean", "_spread")


def below_quantile(frame: DataFrame, value: str, q: float, keys: Keys = ("date",), out: str = "below") -> DataFrame:
    """Flag rows strictly below the linearly interpolated quantile of their cross-section, found by counting."""
    counted = counted_values(frame, value, keys)
    at = (F.col("_all") - 1) * F.lit(float(q))

    def order_statistic(place: Column) -> Column:
        here = (F.col("_below") <= place) & (place < F.col("_below") + F.col("_peers"))
        return F.max(F.when(here, F.col(value)))

    ends = counted.groupBy(*keys).agg(
        order_statistic(F.floor(at)).alias("_low"), order_statistic(F.ceil(at)).alias("_high"), F.max(at - F.floor(at)).alias("_part")
    )
    cut = ends.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("_cut"))
    flagged = F.coalesce(F.col(value) < F.col("_cut"), F.lit(False))
    return frame.join(cut, list(keys), "left").withColumn(out, flagged).drop("_cut")


def top_n(
    scores: DataFrame, n: int | Column, keys: Keys = ("date",), score: str = "score", at_most: int | None = None
) -> DataFrame:
    """Best ``n`` per cross-section with their rank; the symbol decides between ties.

    With a constant ``n`` Spark cuts every group to its best rows before the shuffle. For an ``n`` that
    differs by row, ``at_most`` names an upper bound of it, which brings the same cut.
    """
    by = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col("symbol"))
    ranked = scores.withColumn("rank", F.row_number().over(by))
    if at_most is not None:
        ranked = ranked.filter(F.col("rank") <= at_most)
    return ranked.filter(F.col("rank") <= n)


def leader_gap(scores: DataFrame, keys: Keys = ("date",), score: str = "score") -> DataFrame:
    """Best symbol per cross-section and its lead over the runner-up: only two rows of each are shuffled."""
    best = top_n(scores, 2, keys, score)

    def of(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    return best.groupBy(*keys).agg(
        of(1, "symbol").alias("top_symbol"), of(1, score).alias("top_score"), F.abs(of(1, score) - of(2, score)).alias("gap")
    )


def keep_one(frame: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """Drop duplicates, keeping the row that comes first in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
