"""Performance metrics per group of an equity table (run_id, date, equity).

``keys`` name the group: the run, or the run with a year, period or split. A group holds one row per
session, so its windows are calendar-bounded; benchmarks are one row per session and broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelworks.functions.scalar import ratio

Keys = Sequence[str]

# Fixed values.
RISK_FREE = 0.05
TRADING_DAYS = 252.0
SUBPERIODS = (
    ("pre_covid", "2015-01-01", "2020-02-28"),
    ("covid", "2020-03-01", "2021-12-31"),
    ("post_covid", "2022-01-01", "2100-01-01"),
)
REGIMES = (
    ("bull_2016_2017", "2016-01-01", "2017-12-31"),
    ("bull_2023_2024", "2023-01-01", "2024-12-31"),
    ("bear_2018", "2018-01-01", "2018-12-31"),
    ("bear_2022", "2022-01-01", "2022-12-31"),
    ("covid_crash_2020", "2020-02-19", "2020-03-23"),
    ("covid_recovery_2020", "2020-03-24", "2020-12-31"),
    ("high_vol_2020q1q2", "2020-01-01", "2020-06-30"),
    ("weak_2025", "2025-01-01", "2025-12-31"),
)


def period_table(spark: SparkSession, periods=SUBPERIODS) -> DataFrame:
    rows = spark.createDataFrame(list(periods), "period string, _start string, _end string")
    return rows.select("period", F.col("_start").cast("date").alias("start"), F.col("_end").cast("date").alias("end"))


def in_periods(equity: DataFrame, periods: DataFrame) -> DataFrame:
    """Equity rows of each named, closed range; ranges may overlap."""
    inside = (F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end"))
    return equity.join(F.broadcast(periods), inside).drop("start", "end")


def daily_frame(equity: DataFrame, bench: DataFrame | None = None, keys: Keys = ("run_id",)) -> DataFrame:
    """Daily returns, drawdown, and the benchmark matched by date and carried forward in the group."""
    w = Window.partitionBy(*keys).orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = equity.filter("equity is not null")
    if bench is not None:
        marks = bench.select("date", F.col("close").alias("_bench"))
        out = out.join(F.broadcast(marks), "date", "left").withColumn("bench", F.last("_bench", True).over(so_far))
    else:
        out = out.withColumn("bench", F.lit(None).cast("double"))
    return out.select(
        *keys,
        "date",
        "equity",
        "bench",
        (ratio("equity", F.lag("equity").over(w)) - 1).alias("ret"),
        (ratio("bench", F.lag("bench").over(w)) - 1).alias("bench_ret"),
        (ratio("equity", F.max("equity").over(so_far)) - 1).alias("drawdown"),
    )


def _annual_sharpe(x: Column) -> Column:
    return ratio(F.lit(TRADING_DAYS**0.5) * F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0)))


def _growth(value: str) -> tuple[Column, Column]:
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col("date")))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("date")))
    total = ratio(last, first)
    days = F.greatest(F.datediff(F.max("date"), F.min("date")), F.lit(1))
    return total - 1, F.pow(total, F.lit(365.25) / days) - 1


def sharpe(equity: DataFrame, keys: Keys = ("run_id",)) -> DataFrame:
    """Sharpe ratio without a risk-free rate, NULL below two returns or without spread."""
    d = daily_frame(equity, None, keys)
    return d.groupBy(*keys).agg(
        F.when(F.count("ret") >= 2, _annual_sharpe(F.col("ret"))).alias("sharpe"), F.count("*").alias("n_days")
    )


def summarize(equity: DataFrame, trades: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """Backtest summary per run."""
    d = daily_frame(equity, bench)
    total, annual = _growth("equity")
    b_total, b_annual = _growth("bench")
    enough = F.count("bench") > 1
    curve = d.groupBy("run_id").agg(
        total.alias("total_return"),
        annual.alias("annualized_return"),
        F.min("drawdown").alias("max_drawdown"),
        _annual_sharpe(F.col("ret")).alias("sharpe"),
        F.max_by("equity", "date").alias("ending_equity"),
        F.when(enough, b_total).alias("benchmark_total_return"),
        F.when(enough, b_annual).alias("benchmark_annualized_return"),
    )
    gained = F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0))
    lost = F.coalesce(F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))), F.lit(0.0))
    factor = F.when(lost < 0, ratio(gained, F.abs(lost))).when(gained > 0, F.lit(float("inf")))
    closed = (
        trades.filter("action = 'SELL'")
        .groupBy("run_id")
        .agg(
            factor.alias("profit_factor"),
            F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
            F.count("*").alias("num_closed_trades"),
        )
    )
    return curve.join(closed, "run_id", "left").fillna(0, ["num_closed_trades"])


def extended_metrics(
    equity: DataFrame, bench: DataFrame, rf: float = RISK_FREE, keys: Keys = ("run_id",)
) -> DataFrame:
    """Growth, risk and benchmark-relative metrics per group of at least two sessions."""
    d = daily_frame(equity, bench, keys)
    total, cagr = _growth("equity")
    excess = F.col("ret") - rf / TRADING_DAYS
    down = F.when(F.col("ret") < 0, F.col("ret"))
    diff = F.col("ret") - F.col("bench_ret")
    daily = (
        d.groupBy(*keys)
        .agg(
            F.count("*").alias("_rows"),
            cagr.alias("cagr"),
            total.alias("total_return"),
            _annual_sharpe(excess).alias("sharpe"),
            ratio(F.lit(TRADING_DAYS**0.5) * F.avg(excess), F.nullif(F.stddev_samp(down), F.lit(0.0))).alias("sortino"),
            F.min("drawdown").alias("max_drawdown"),
            _annual_sharpe(diff).alias("information_ratio"),
            F.max_by("equity", "date").alias("ending_equity"),
        )
        .filter("_rows >= 2")
        .drop("_rows")
        .withColumn("calmar", ratio("cagr", F.nullif(F.abs("max_drawdown"), F.lit(0.0))))
    )
    months = d.groupBy(*keys, F.trunc("date", "month").alias("_month")).agg(
        F.max_by("equity", "date").alias("_e"), F.max_by("bench", "date").alias("_b")
    )
    w = Window.partitionBy(*keys).orderBy("_month")
    months = months.select(
        *keys,
        (ratio("_e", F.lag("_e").over(w)) - 1).alias("_me"),
        (ratio("_b", F.lag("_b").over(w)) - 1).alias("_mb"),
    )
    monthly = months.groupBy(*keys).agg(
        F.avg((F.col("_me") > 0).cast("double")).alias("win_rate_monthly"),
        F.avg((F.col("_me") > F.col("_mb")).cast("double")).alias("batting_avg"),
        F.count("_me").alias("n_months"),
    )
    return daily.join(monthly, list(keys))


def segments(equity: DataFrame, keys: Keys, rf: float = RISK_FREE) -> DataFrame:
    """What has to be known of a stretch of an equity curve so that stretches can be joined without their days: bounds,
    first and last value, peak, trough, worst fall, and count, sum and squares of the excess returns inside."""
    excess = F.col("ret") - rf / TRADING_DAYS
    return daily_frame(equity, None, keys).groupBy(*keys).agg(
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.min_by("equity", "date").alias("first"),
        F.max_by("equity", "date").alias("last"),
        F.max("equity").alias("peak"),
        F.min("equity").alias("trough"),
        F.min("drawdown").alias("worst"),
        F.count("ret").alias("n"),
        F.coalesce(F.sum(excess), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(excess * excess), F.lit(0.0)).alias("square"),
    )


def joined_before(parts: DataFrame, by: str, order: str, rf: float = RISK_FREE) -> DataFrame:
    """For each segment of ``by`` all earlier ones, in ``order``, as one segment (NULLs for the first).

    The return from one segment to the next counts as well; a fall can reach from the peak of any earlier segment.
    Windows run over segments, so every prefix is valued from a few rows.
    """
    w = Window.partitionBy(by).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    step = ratio("first", F.lag("last").over(w)) - 1 - rf / TRADING_DAYS
    linked = parts.withColumns({"_step": step, "_high": F.max("peak").over(before)}).withColumn(
        "_fall", F.least("worst", ratio("trough", "_high") - 1)
    )
    steps = F.coalesce("_step", F.lit(0.0))
    return linked.select(
        by,
        order,
        F.first("start").over(before).alias("start"),
        F.last("end").over(before).alias("end"),
        F.first("first").over(before).alias("first"),
        F.last("last").over(before).alias("last"),
        F.max("peak").over(before).alias("peak"),
        F.min("trough").over(before).alias("trough"),
        F.min("_fall").over(before).alias("worst"),
        F.sum(F.col("n") + F.col("_step").isNotNull().cast("long")).over(before).alias("n"),
        F.sum(F.col("total") + steps).over(before).alias("total"),
        F.sum(F.col("square") + steps * steps).over(before).alias("square"),
    )


def segment_metrics(parts: DataFrame, keys: Keys) -> DataFrame:
    """Sharpe, growth, worst fall and their ratio of segments; NULL where there are fewer than two returns."""
    n, spread = F.col("n"), F.col("square") - F.col("total") * F.col("total") / F.nullif(F.col("n"), F.lit(0))
    deviation = F.sqrt(F.greatest(ratio(spread, F.nullif(n - 1, F.lit(0))), F.lit(0.0)))
    days = F.greatest(F.datediff("end", "start"), F.lit(1))
    cagr = F.pow(ratio("last", "first"), F.lit(365.25) / days) - 1
    return parts.select(
        *keys,
        F.when(n >= 2, F.lit(TRADING_DAYS**0.5) * ratio(F.col("total") / n, F.nullif(deviation, F.lit(0.0)))).alias("sharpe"),
        cagr.alias("cagr"),
        F.col("worst").alias("max_drawdown"),
        ratio(cagr, F.nullif(F.abs("worst"), F.lit(0.0))).alias("calmar"),
    )


def choose_by_prior_sharpe(equity: DataFrame, option: str) -> DataFrame:
    """(year, option, prior_sharpe, oos_sharpe, oos_cagr, oos_max_drawdown, oos_calmar): for each year the option whose
    curve had the best Sharpe ratio on all earlier dates, and its metrics in the year itself, counted from the year's
    first session. ``equity`` is (option, date, equity); the smallest option wins a tie."""
    parts = segments(equity.withColumn("year", F.year("date")), [option, "year"])
    keys = [option, "year"]
    prior = segment_metrics(joined_before(parts, option, "year"), keys).select(*keys, F.col("sharpe").alias("prior_sharpe"))
    own = segment_metrics(parts, keys).withColumnsRenamed({m: f"oos_{m}" for m in ("sharpe", "cagr", "max_drawdown", "calmar")})
    best = Window.partitionBy("year").orderBy(F.desc("prior_sharpe"), option)
    rated = prior.where("prior_sharpe IS NOT NULL").withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")
    return rated.join(own, keys)


def year_metrics(equity: DataFrame, bench: DataFrame, as_of_year: int | None = None, rf: float = RISK_FREE) -> DataFrame:
    """Metrics per calendar year; years from ``as_of_year`` on are partial and left out."""
    dated = equity.withColumn("year", F.year("date"))
    if as_of_year is not None:
        dated = dated.filter(F.col("year") < as_of_year)
    return extended_metrics(dated, bench, rf, ["run_id", "year"])


def summarize_years(years: DataFrame) -> DataFrame:
    """Worst, best, mean and population deviation of the yearly Sharpe ratios, and the robust score."""
    s = F.col("sharpe")
    out = years.groupBy("run_id").agg(
        F.min(s).alias("worst_year_sharpe"),
        F.max(s).alias("best_year_sharpe"),
        F.avg(s).alias("mean_year_sharpe"),
        F.stddev_pop(s).alias("std_year_sharpe"),
        F.count(s).alias("n_years"),
    )
    return out.withColumn("robust_score", F.col("mean_year_sharpe") - 0.5 * F.col("std_year_sharpe"))


def per_fold(equity: DataFrame, splits: DataFrame, train: DataFrame, clean_train: DataFrame) -> DataFrame:
    """Out-of-sample Sharpe of every split's test range, with its training dates lost to the leak rule."""
    ranges = splits.select("split_id", F.col("test_start").alias("start"), F.col("test_end").alias("end"))
    inside = (F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end"))
    rows = equity.join(F.broadcast(ranges), inside).drop("start", "end")
    out = sharpe(rows, ["run_id", "split_id"]).withColumnRenamed("sharpe", "oos_sharpe")
    total = train.groupBy("split_id").agg(F.count("*").alias("n_train"))
    kept = clean_train.groupBy("split_id").agg(F.count("*").alias("_kept"))
    lost = total.join(kept, "split_id", "left").select(
        "split_id", "n_train", (F.col("n_train") - F.coalesce("_kept", F.lit(0))).alias("n_train_stripped")
    )
    return out.join(F.broadcast(lost), "split_id", "left")


def objective_score(
    metrics: DataFrame,
    limit: float = 0.50,
    return_weight: float = 100.0,
    factor_weight: float = 10.0,
    drawdown_weight: float = 50.0,
) -> DataFrame:
    """Search objective: weighted return and capped profit factor minus drawdown, with a steep penalty
    beyond the drawdown limit."""

    def finite(c: str, default: float) -> Column:
        bad = F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(bad, F.lit(default)).otherwise(F.col(c))

    drop = F.abs("max_drawdown")
    score = (
        finite("annualized_return", -1.0) * return_weight
        + F.least(finite("profit_factor", 0.0), F.lit(5.0)) * factor_weight
        - drop * drawdown_weight
    )
    penalty = F.when(drop > limit, 1000.0 * (drop - limit)).otherwise(F.lit(0.0))
    return metrics.withColumn("score", score - penalty)


def count_summary(flags: DataFrame) -> DataFrame:
    """Eligible symbols per date, summarised over the dates."""
    per_date = flags.groupBy("date").agg(F.count_if("eligible").alias("n"))
    return per_date.agg(
        F.min("n").alias("min_n"),
        F.avg("n").alias("mean_n"),
        F.median("n").alias("median_n"),
        F.max("n").alias("max_n"),
        F.sum("n").alias("sum_n"),
    )
