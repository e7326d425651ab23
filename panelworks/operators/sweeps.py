"""Parameter sweeps, robustness summaries, and audits of coverage and leakage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.functions.scalar import ratio


def run_spread(metrics: DataFrame, columns: Sequence[str], limit: float = 0.05) -> DataFrame:
    """Mean, population deviation and coefficient of variation of each metric over the runs; a metric
    is stable when the coefficient stays below ``limit``."""
    long = metrics.unpivot(["run_id"], list(columns), "metric", "value").filter("value is not null")
    stats = long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n_runs")
    )
    cv = F.abs(ratio("std", "mean"))
    return stats.withColumn("cv", cv).withColumn("stable", F.coalesce(cv < limit, F.lit(False)))


def sensitivity_spread(metrics: DataFrame, worst: str = "worst_year_sharpe", sharpe: str = "sharpe") -> DataFrame:
    """One row: spread of the worst year and of the Sharpe ratio over the variants, the share of Sharpe
    lost in the worst variant, and whether both stay within bounds."""
    out = metrics.agg(
        (F.max(worst) - F.min(worst)).alias("worst_spread"),
        (F.max(sharpe) - F.min(sharpe)).alias("sharpe_spread"),
        F.when(F.max(sharpe) > 0, (F.max(sharpe) - F.min(sharpe)) / F.max(sharpe)).alias("sharpe_collapse"),
    )
    ok = (F.col("worst_spread") < 0.5) & (F.col("sharpe_collapse") < 0.30)
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


def leaderboard(results: DataFrame, order: str, drawdown_limit: float) -> DataFrame:
    """Keep a result that respects the drawdown limit and beats every earlier one that did. ``results``
    has one row per experiment, so the running maximum is over the experiment log only."""
    allowed = F.abs("max_drawdown") <= drawdown_limit
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(allowed, F.col("score"))).over(before)
    out = results.withColumn("best_before", best)
    keep = allowed & (F.col("best_before").isNull() | (F.col("score") > F.col("best_before")))
    return out.withColumn("status", F.when(keep, "keep").otherwise("discard"))


def config_hash(params: Column) -> Column:
    """First 12 hex digits of the SHA-1 of the parameters' JSON."""
    return F.substring(F.sha1(F.to_json(params)), 1, 12)


def describe_difference(paths: Sequence[str], base: str, candidate: str) -> Column:
    """Changed paths as ``path=value``, in path order, or ``baseline``."""
    parts = []
    for p in sorted(paths):
        a, b = F.col(base)[p], F.col(candidate)[p]
        parts.append(F.when(~a.eqNullSafe(b), F.concat(F.lit(f"{p}="), b.cast("string"))))
    text = F.concat_ws("; ", *parts)
    return F.when(text == "", F.lit("baseline")).otherwise(text)


def sample_candidates(
    candidates: DataFrame,
    space: Mapping[str, Sequence[float]],
    base: Mapping[str, float],
    max_changes: int,
    seed: int,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Random parameter sets, one per row of ``candidates(candidate_id)``, without repeats: of equal sets the smallest
    candidate stays. A null candidate draws nothing.

    Which paths change, how many and to what is decided by hashes of the seed, the candidate and the
    option, so a sample does not depend on partitioning. Options equal to the base value are not drawn.
    Parameter sets already ``seen`` (column ``config_hash``) are dropped.

    A candidate's draw is one expression over its row; only distinct sets of each task are shuffled.
    """
    paths = sorted(space)
    options = {p: [float(v) for v in space[p] if float(v) != float(base[p])] for p in paths}
    open_paths = [p for p in paths if options[p]]

    def draw(*parts: Column | str) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))

    def drawn(path: str) -> Column:
        """The option of ``path`` whose hash is the smallest."""
        made = [F.struct(draw("candidate_id", F.lit(path), F.lit(v).cast("string")).alias("hash"), F.lit(v).alias("value")) for v in options[path]]
        return F.array_min(F.array(*made))["value"]

    changes = F.conv(F.substring(draw("candidate_id"), 1, 8), 16, 10).cast("bigint") % max_changes + 1
    ranked = F.array_sort(F.array(*[F.struct(draw("candidate_id", F.lit(p)).alias("hash"), F.lit(p).alias("path")) for p in open_paths]))
    rows = candidates.select("candidate_id").where("candidate_id IS NOT NULL" if open_paths else "false")
    if open_paths:
        rows = rows.withColumn("_picked", F.transform(F.slice(ranked, F.lit(1), changes.cast("int")), lambda x: x["path"]))
    values = [
        F.when(F.array_contains("_picked", p), drawn(p)).otherwise(F.lit(float(base[p]))) if options[p] else F.lit(float(base[p]))
        for p in paths
    ]
    sets = rows.select("candidate_id", *[v.alias(f"_{i}") for i, v in enumerate(values)])
    distinct = sets.groupBy(*[f"_{i}" for i in range(len(paths))]).agg(F.min("candidate_id").alias("candidate_id"))
    params = F.struct(*[F.col(f"_{i}").alias(p) for i, p in enumerate(paths)])
    out = distinct.select("candidate_id", params.alias("params"))
    out = out.withColumn("config_hash", config_hash(F.col("params")))
    return out if seen is None else out.join(seen.select("config_hash"), "config_hash", "left_anti")


def leak_audit(splits: DataFrame, train: DataFrame, clean_train: DataFrame) -> DataFrame:
    """One row: splits whose training reaches into the test range, and training rows the rule removed."""
    overlap = splits.agg(F.count("*").alias("n_splits"), F.count_if(F.col("train_end") >= F.col("test_start")).alias("overlapping"))
    rows = train.agg(F.count("*").alias("train_rows")).crossJoin(clean_train.agg(F.count("*").alias("clean_rows")))
    return overlap.crossJoin(rows).withColumn("stripped", F.col("train_rows") - F.col("clean_rows"))


def symbol_coverage(universe: DataFrame, forecasts: DataFrame) -> DataFrame:
    """(symbol, status): covered, missing (no forecast at all) or extra (forecast of an unknown symbol)."""
    u = universe.select("symbol", F.lit(True).alias("_u")).distinct()
    f = forecasts.select("symbol", F.lit(True).alias("_f")).distinct()
    status = F.when(F.col("_f").isNull(), "missing").when(F.col("_u").isNull(), "extra").otherwise("covered")
    return u.join(f, "symbol", "full_outer").select("symbol", status.alias("status"))


def date_coverage(eligible: DataFrame, forecasts: DataFrame) -> DataFrame:
    """(date, eligible, missing, zero_coverage) over the eligible symbols of each date."""
    have = forecasts.select("symbol", "date", F.lit(1).alias("_have")).distinct()
    joined = eligible.select("symbol", "date").join(have, ["symbol", "date"], "left")
    missing = F.count("*") - F.count("_have")
    return joined.groupBy("date").agg(
        F.count("*").alias("eligible"), missing.alias("missing"), (missing == F.count("*")).alias("zero_coverage")
    )


def yearly_coverage(per_date: DataFrame) -> DataFrame:
    by_year = per_date.groupBy(F.year("date").alias("year")).agg(
        F.sum("missing").alias("missing"), F.sum("eligible").alias("eligible"), F.max("missing").alias("worst")
    )
    return by_year.withColumn("missing_share", ratio("missing", "eligible"))


def null_cells(forecasts: DataFrame, column: str = "mean") -> DataFrame:
    """One row: cells of the forecast arrays and how many are NULL or NaN, counted in place."""
    bad = F.size(F.filter(column, lambda x: x.isNull() | F.isnan(x)))
    return forecasts.agg(F.sum(F.size(column)).alias("cells"), F.sum(bad).alias("null_cells"))


def point_in_time(dates: DataFrame) -> DataFrame:
    """(date, prior_end, lag_days, ok): data used at a date has to end strictly before it."""
    return dates.select(
        "date", "prior_end", F.datediff("date", "prior_end").alias("lag_days"), (F.col("prior_end") < F.col("date")).alias("ok")
    )


def selected_without_forecast(targets: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Selected names that had no forecast and so escaped the veto, by year."""
    escaped = targets.join(forecasts.select("symbol", "date"), ["symbol", "date"], "left_anti")
    return escaped.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("names"), F.countDistinct("date").alias("dates")
    )
