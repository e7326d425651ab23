"""Metric queries over the valued runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.catalog import portfolio, tables, walk_forward  # noqa: F401  (shared table expressions)
from panelworks.catalog.base import r4
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.catalog.sources import staged
from panelworks.operators import metrics as mt
from panelworks.operators import portfolio as pf
from panelworks.operators import walkforward as wf
from panelworks.sinks import tables as sink
from panelworks.sources import market

# Ranges that overlap and fall into the tables' years.
PERIODS = (
    ("early", "1996-01-01", "1997-12-31"),
    ("mid", "1997-07-01", "1999-06-30"),
    ("late", "1999-07-01", "2100-01-01"),
    ("full", "1995-01-01", "2100-01-01"),
)
cte("periods", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS) + ") t(period, lo, hi)")

METRICS = (
    "cagr",
    "total_return",
    "sharpe",
    "sortino",
    "max_drawdown",
    "calmar",
    "win_rate_monthly",
    "information_ratio",
    "batting_avg",
)


#: Compared on a compressed scale: rounding a growth factor of 100,000 to 4 decimals compares noise of the summation.
GROWTH = ("cagr", "total_return", "annualized_return", "benchmark_total_return", "benchmark_annualized_return", "calmar", "profit_factor", "score")


def scaled_sql(name: str, digits: int = 4) -> str:
    return f"round({f'asinh({name})' if name in GROWTH else name}, {digits}) AS {name}"


def scaled(frame, names, digits: int = 4):
    return r4(frame.withColumns({n: F.asinh(n) for n in names if n in GROWTH}), *names, digits=digits)


def daily_sql(source: str, keys: str) -> str:
    return f"""SELECT *, equity / lag(equity) OVER w - 1 AS ret, bench / lag(bench) OVER w - 1 AS bench_ret,
    equity / max(equity) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM (SELECT e.*,
    last_value(b.close IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY e.date ROWS UNBOUNDED PRECEDING) AS bench FROM {source} e
    LEFT JOIN bench b ON b.date = e.date) WINDOW w AS (PARTITION BY {keys} ORDER BY date)"""


def extended_sql(name: str, source: str, keys: str, uses: tuple[str, ...]) -> None:
    """Extended metrics of ``source`` grouped by ``keys`` as the table expression ``name``."""
    cte(f"{name}_daily", daily_sql(source, keys), (*uses, "bench"))
    ex = "ret - 0.05 / 252"
    cte(
        name,
        f"""SELECT *, cagr / nullif(abs(max_drawdown), 0) AS calmar FROM (SELECT {keys}, count(*) AS n,
        arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return,
        pow(arg_max(equity, date) / arg_min(equity, date), 365.25 / greatest(1, max(date) - min(date))) - 1 AS cagr,
        sqrt(252) * avg({ex}) / nullif(stddev_samp({ex}), 0) AS sharpe,
        sqrt(252) * avg({ex}) / nullif(stddev_samp(ret) FILTER (ret < 0), 0) AS sortino, min(drawdown) AS max_drawdown,
        sqrt(252) * avg(ret - bench_ret) / nullif(stddev_samp(ret - bench_ret), 0) AS information_ratio,
        arg_max(equity, date) AS ending_equity FROM {name}_daily GROUP BY {keys}) JOIN (
        SELECT {keys}, avg(CAST(me > 0 AS DOUBLE)) AS win_rate_monthly, avg(CAST(me > mb AS DOUBLE)) AS batting_avg, count(me) AS n_months FROM (
        SELECT {keys}, e / lag(e) OVER w - 1 AS me, b / lag(b) OVER w - 1 AS mb FROM (SELECT {keys}, date_trunc('month', date) AS m,
        arg_max(equity, date) AS e, arg_max(bench, date) AS b FROM {name}_daily GROUP BY ALL) WINDOW w AS (PARTITION BY {keys} ORDER BY m))
        GROUP BY {keys}) USING ({keys}) WHERE n >= 2""",
        (f"{name}_daily",),
    )


cte("wt_years", "SELECT *, year(date) AS year FROM wt_equity", ("wt_equity",))
cte(
    "wt_periods_named",
    "SELECT e.*, p.period FROM wt_equity e JOIN periods p ON e.date BETWEEN p.lo AND p.hi",
    ("wt_equity", "periods"),
)
extended_sql("ext_run", "wt_equity", "run_id", ("wt_equity",))
extended_sql("ext_year", "wt_years", "run_id, year", ("wt_years",))
extended_sql("ext_period", "wt_periods_named", "run_id, period", ("wt_periods_named",))

PICKED = ", ".join(scaled_sql(m) for m in METRICS)


def _rounded(frame, *keys):
    return scaled(frame.select(*keys, *METRICS, "n_months"), METRICS)


def _bench(p):
    return market.benchmark(p.prices)


cte(
    "summary",
    f"""SELECT d.run_id, arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return,
    pow(arg_max(equity, date) / arg_min(equity, date), 365.25 / greatest(1, max(date) - min(date))) - 1 AS annualized_return,
    min(drawdown) AS max_drawdown, sqrt(252) * avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe,
    any_value(t.profit_factor) AS profit_factor, any_value(t.win_rate) AS win_rate, any_value(t.n) AS num_closed_trades,
    arg_max(bench, date) / arg_min(bench, date) - 1 AS benchmark_total_return,
    pow(arg_max(bench, date) / arg_min(bench, date), 365.25 / greatest(1, max(date) - min(date))) - 1 AS benchmark_annualized_return
    FROM ext_run_daily d JOIN (SELECT run_id, sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl < 0)) AS profit_factor,
    avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate, count(*) AS n FROM wt_trades WHERE action = 'SELL' GROUP BY 1) t ON t.run_id = d.run_id GROUP BY 1""",
    ("ext_run_daily", "wt_trades"),
)
SUMMARY = (
    "total_return",
    "annualized_return",
    "max_drawdown",
    "sharpe",
    "profit_factor",
    "win_rate",
    "benchmark_total_return",
    "benchmark_annualized_return",
)


def _summary(spark, sf_dir):
    p, px, v = portfolio.weighted(spark, sf_dir)
    equity = pf.equity_curve(v, px, p.sessions, portfolio.CAPITAL)
    return mt.summarize(equity, pf.trades(v, px, p.sessions, portfolio.COST), _bench(p))


@query(
    "ag_01_backtest_summary",
    check_sql(
        f"SELECT run_id, {', '.join(map(scaled_sql, SUMMARY))}, num_closed_trades FROM summary", "summary"
    ),
)
def summary(spark, sf_dir):
    return scaled(_summary(spark, sf_dir).drop("ending_equity"), SUMMARY)


@query("ag_02_extended_metrics", check_sql(f"SELECT run_id, {PICKED}, n_months FROM ext_run", "ext_run"))
def extended(spark, sf_dir):
    p, equity = portfolio.weighted_equity(spark, sf_dir)
    return _rounded(mt.extended_metrics(equity, _bench(p)), "run_id")


@query(
    "ag_03_year_metrics",
    check_sql(f"SELECT run_id, CAST(year AS INTEGER) AS year, {PICKED}, n_months FROM ext_year WHERE year < 2001", "ext_year"),
)
def years(spark, sf_dir):
    p, equity = portfolio.weighted_equity(spark, sf_dir)
    return _rounded(mt.year_metrics(equity, _bench(p), as_of_year=2001), "run_id", "year")


YEARLY = ("worst_year_sharpe", "best_year_sharpe", "mean_year_sharpe", "std_year_sharpe", "robust_score")


@query(
    "ag_04_year_summary",
    check_sql(
        f"""SELECT run_id, {', '.join(f'round({c}, 4) AS {c}' for c in YEARLY)}, n_years FROM (SELECT *, mean_year_sharpe - 0.5 * std_year_sharpe AS robust_score
        FROM (SELECT run_id, min(sharpe) AS worst_year_sharpe, max(sharpe) AS best_year_sharpe, avg(sharpe) AS mean_year_sharpe,
        stddev_pop(sharpe) AS std_year_sharpe, count(sharpe) AS n_years FROM ext_year GROUP BY run_id))""",
        "ext_year",
    ),
)
def year_summary(spark, sf_dir):
    p, equity = portfolio.weighted_equity(spark, sf_dir)
    return r4(mt.summarize_years(mt.year_metrics(equity, _bench(p))), *YEARLY)


@query("ag_05_subperiod_metrics", check_sql(f"SELECT run_id, period, {PICKED}, n_months FROM ext_period", "ext_period"))
def subperiods(spark, sf_dir):
    p, equity = portfolio.weighted_equity(spark, sf_dir)
    named = mt.in_periods(equity, mt.period_table(spark, PERIODS))
    return _rounded(mt.extended_metrics(named, _bench(p), keys=["run_id", "period"]), "run_id", "period")


PLAIN_SHARPE = "CASE WHEN count(ret) >= 2 THEN sqrt(252) * avg(ret) / nullif(stddev_samp(ret), 0) END"


@query(
    "ag_06_regime_report",
    check_sql(
        f"SELECT run_id, period, round({PLAIN_SHARPE}, 4) AS sharpe, count(*) AS n_days FROM ext_period_daily GROUP BY 1, 2",
        "ext_period_daily",
    ),
)
def regimes(spark, sf_dir):
    _, equity = portfolio.weighted_equity(spark, sf_dir)
    return r4(mt.sharpe(mt.in_periods(equity, mt.period_table(spark, PERIODS)), ["run_id", "period"]), "sharpe")


cte(
    "folds",
    f"""SELECT f.run_id, f.split_id, f.sharpe AS oos_sharpe, f.n_days, t.n AS n_train, t.n - coalesce(c.n, 0) AS n_train_stripped FROM (
    SELECT run_id, split_id, {PLAIN_SHARPE} AS sharpe, count(*) AS n_days FROM (SELECT e.run_id, s.split_id, e.equity / lag(e.equity)
    OVER (PARTITION BY e.run_id, s.split_id ORDER BY e.date) - 1 AS ret FROM wt_equity e JOIN splits s ON e.date BETWEEN s.test_start AND s.test_end)
    GROUP BY 1, 2) f LEFT JOIN (SELECT split_id, count(*) AS n FROM train GROUP BY 1) t USING (split_id)
    LEFT JOIN (SELECT split_id, count(*) AS n FROM clean_train GROUP BY 1) c USING (split_id)""",
    ("wt_equity", "splits", "train", "clean_train"),
)


@query(
    "ag_07_out_of_sample_folds",
    check_sql("SELECT run_id, split_id, round(oos_sharpe, 4) AS oos_sharpe, n_days, n_train, n_train_stripped FROM folds", "folds"),
)
def folds(spark, sf_dir):
    p, equity = portfolio.weighted_equity(spark, sf_dir)
    days = tables.monthly(p)
    splits = wf.build_splits(days, walk_forward.WF)
    train = wf.train_dates(splits, days)
    return r4(mt.per_fold(equity, splits, train, wf.strip_leaky(train)), "oos_sharpe")


@query(
    "ag_08_objective_score",
    check_sql(
        """SELECT run_id, round(asinh(annualized_return * 100 + least(coalesce(profit_factor, 0), 5) * 10 - abs(max_drawdown) * 50
        - CASE WHEN abs(max_drawdown) > 0.5 THEN 1000 * (abs(max_drawdown) - 0.5) ELSE 0 END), 6) AS score FROM summary""",
        "summary",
    ),
)
def objective(spark, sf_dir):
    return scaled(mt.objective_score(_summary(spark, sf_dir)).select("run_id", "score"), ["score"], 6)


@query(
    "ag_09_heat_map",
    check_sql(
        "SELECT run_id, "
        + ", ".join(f'round(max(sharpe) FILTER (period = \'{n}\'), 4) AS "{n}"' for n, _, _ in PERIODS)
        + " FROM ext_period GROUP BY run_id",
        "ext_period",
    ),
)
def heat_map(spark, sf_dir):
    p, equity = portfolio.weighted_equity(spark, sf_dir)
    cells = mt.extended_metrics(mt.in_periods(equity, mt.period_table(spark, PERIODS)), _bench(p), keys=["run_id", "period"])
    names = [n for n, _, _ in PERIODS]
    return r4(sink.heat_map(cells, "run_id", "period", "sharpe", names), *names)


@query(
    "ag_10_value_counts",
    check_sql("SELECT symbol, count(*) AS n, round(avg(weight), 6) AS mean_weight FROM targets WHERE symbol IS NOT NULL GROUP BY symbol", "targets"),
)
def value_counts(spark, sf_dir):
    t = portfolio.base_targets(spark, sf_dir, market.stored_panel(spark, sf_dir)).filter("symbol is not null")
    return r4(t.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("weight").alias("mean_weight")), "mean_weight", digits=6)


@query(
    "ag_11_eligible_counts",
    check_sql(
        """SELECT min(n) AS min_n, round(avg(n), 4) AS mean_n, median(n) AS median_n, max(n) AS max_n, CAST(sum(n) AS BIGINT) AS sum_n FROM (
        SELECT date, count(*) FILTER (eligible) AS n FROM mask WHERE date IN (SELECT date FROM rebal) GROUP BY date)""",
        "mask",
        "rebal",
    ),
)
def eligible_counts(spark, sf_dir):
    p = market.panel(spark, sf_dir)
    at = tables.mask(spark, sf_dir, p).join(F.broadcast(tables.monthly(p)), "date", "left_semi")
    return r4(mt.count_summary(at), "mean_n")


RESULT_SCHEMA = "run_id string, period string, sharpe double, max_drawdown double"


@query(
    "snk_04_results_and_heat_map",
    check_sql("SELECT run_id, period, round(sharpe, 4) AS sharpe, round(max_drawdown, 4) AS max_drawdown FROM ext_period", "ext_period"),
)
def results(spark, sf_dir):
    p, equity = portfolio.weighted_equity(spark, sf_dir)
    path = staged(spark, "results")
    rows = mt.extended_metrics(mt.in_periods(equity, mt.period_table(spark, PERIODS)), _bench(p), keys=["run_id", "period"])
    sink.append_log(r4(rows.select("run_id", "period", "sharpe", "max_drawdown"), "sharpe", "max_drawdown"), path)
    return sink.read_log(spark, path, RESULT_SCHEMA)
