"""Forecast queries. The store is filled by the built-in deterministic scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.catalog import alignment, tables  # noqa: F401  (shared table expressions)
from panelworks.catalog.base import r4, rnd
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.operators import forecast as fc
from panelworks.operators.panel import log_returns
from panelworks.catalog.sources import staged
from panelworks.operators.stage import materialize
from panelworks.sources import market
from panelworks.sources.forecasts import Reading, store

CTX, HOR = 60, 21

cte(
    "requests",
    """SELECT v.symbol, r.date, v.series FROM rebal_prior r JOIN (SELECT symbol, date, list(volume) FILTER (volume IS NOT NULL)
    OVER (PARTITION BY symbol ORDER BY date ROWS 63 PRECEDING) AS series FROM panel) v ON v.date = r.prior_end
    WHERE len(v.series) >= 24""",
    ("rebal_prior", "panel"),
)
cte(
    "contexts",
    """SELECT symbol, date, list_concat(list_resize(CAST([] AS DOUBLE[]), 64 - least(64, len(series)), 0.0),
    list_slice(series, greatest(1, len(series) - 63), len(series))) AS context FROM requests""",
    ("requests",),
)
cte(
    "mean_forecasts",
    """SELECT symbol, date, list_resize([list_avg(list_slice(context, -21, -1))], 21, list_avg(list_slice(context, -21, -1))) AS mean
    FROM contexts""",
    ("contexts",),
)
cte(
    "quantile_forecasts",
    """SELECT symbol, date, list_avg(context) AS mean, list_aggregate(context, 'quantile_cont', 0.2) AS q0,
    list_aggregate(context, 'quantile_cont', 0.5) AS q1, list_aggregate(context, 'quantile_cont', 0.9) AS q2 FROM contexts""",
    ("contexts",),
)


def requests(p):
    return fc.context_requests(p.prices, "volume", tables.prior_ends(p), CTX, 24)


def mean_forecasts(p):
    return fc.forecast(requests(p), fc.trailing_mean_scorer(21), HOR, CTX, "volume")


def quantile_forecasts(p):
    return fc.forecast(requests(p), fc.empirical_quantile_scorer([0.2, 0.5, 0.9]), HOR, CTX, "volume")


def _context_sql(source: str, value: str, need: int, pad: str) -> str:
    """Contexts of a series: the values among the last 64 sessions up to the prior end, padded on the left."""
    return f"""SELECT symbol, date, list_concat(list_resize(CAST([] AS DOUBLE[]), 64 - len(series), CAST({pad} AS DOUBLE)), series) AS context FROM (
    SELECT v.symbol, r.date, v.series FROM rebal_prior r JOIN (SELECT symbol, date, list({value}) FILTER ({value} IS NOT NULL)
    OVER (PARTITION BY symbol ORDER BY date ROWS 63 PRECEDING) AS series FROM {source}) v ON v.date = r.prior_end WHERE len(v.series) >= {need})"""


cte("volume_contexts", _context_sql("panel", "volume", 24, "0"), ("panel", "rebal_prior"))
cte("price_contexts", _context_sql("panel", "close", 24, "series[1]"), ("panel", "rebal_prior"))
cte(
    "return_steps",
    "SELECT symbol, date, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY date) AS r FROM panel",
    ("panel",),
)
cte("return_contexts", _context_sql("return_steps", "r", 12, "0"), ("return_steps", "rebal_prior"))
cte(
    "readings",
    """SELECT coalesce(v.symbol, p.symbol, x.symbol) AS symbol, coalesce(v.date, p.date, x.date) AS date, list_avg(v.context[-21:]) AS volume,
    list_avg(v.context[-5:]) AS short_volume, p.context[64] + 11 * (p.context[64] - p.context[1]) / 63 AS price,
    21 * list_avg(x.context[-21:]) AS return_21, 60 * list_avg(x.context[-60:]) AS return_60, 5 * list_avg(x.context[-5:]) AS return_5
    FROM volume_contexts v FULL JOIN price_contexts p ON p.symbol = v.symbol AND p.date = v.date
    FULL JOIN return_contexts x ON x.symbol = coalesce(v.symbol, p.symbol) AND x.date = coalesce(v.date, p.date)""",
    ("volume_contexts", "price_contexts", "return_contexts"),
)
def wanted_readings() -> dict[str, Reading]:
    """What the vetoes read from the store."""
    return {
        "volume": Reading(CTX, 21, "volume", fc.mean_sum(21) / 21),
        "short_volume": Reading(CTX, 5, "volume", fc.mean_sum(5) / 5),
        "price": Reading(CTX, 21, "price", fc.mean_sum(21) / 21),
        "return_21": Reading(CTX, 21, "logret", fc.mean_sum(21)),
        "return_60": Reading(CTX, 60, "logret", fc.mean_sum(60)),
        "return_5": Reading(CTX, 5, "logret", fc.mean_sum(5)),
    }


def filled_store(spark, p) -> str:
    """A forecast store of three kinds and three horizons, and with quantiles of one, at the monthly rebalances."""
    path = staged(spark, "forecast-store")
    ends, steps = tables.prior_ends(p), log_returns(p.prices)
    volume = materialize(fc.context_requests(p.prices, "volume", ends, CTX, 24), "volume_requests")
    price = fc.context_requests(p.prices, "close", ends, CTX, 24)
    returns = materialize(fc.context_requests(steps, "logret", ends, CTX, 12), "return_requests")
    mean = fc.trailing_mean_scorer
    for requests_, scorer, hor, kind in (
        (volume, mean(21), 21, "volume"),
        (volume, mean(5), 5, "volume"),
        (price, fc.drift_scorer(), 21, "price"),
        (returns, mean(21), 21, "logret"),
        (returns, mean(60), 60, "logret"),
        (returns, mean(5), 5, "logret"),
    ):
        store(fc.forecast(requests_, scorer, hor, CTX, kind).drop("q"), path, CTX, hor, kind, False)
    return path


@query("fc_01_context_requests", check_sql("SELECT symbol, date, series FROM requests", "requests"))
def context_requests(spark, sf_dir):
    return requests(market.panel(spark, sf_dir))


@query(
    "fc_01_missing_requests",
    check_sql(
        """SELECT symbol, date, len(series) AS n FROM requests r ANTI JOIN (SELECT symbol, date FROM requests WHERE date < DATE '1999-06-01') c
        ON c.symbol = r.symbol AND c.date = r.date""",
        "requests",
    ),
)
def missing_requests(spark, sf_dir):
    every = requests(market.stored_panel(spark, sf_dir))
    stored = every.filter("date < date'1999-06-01'")
    return fc.missing_requests(every, stored).select("symbol", "date", F.size("series").cast("bigint").alias("n"))


@query("fc_02_prepared_context", check_sql("SELECT symbol, date, context FROM contexts", "contexts"))
def prepared_context(spark, sf_dir):
    r = requests(market.panel(spark, sf_dir))
    return r.select("symbol", "date", fc.prepared_context("series", CTX, "volume").alias("context"))


@query(
    "fc_03_batch_scoring",
    check_sql("SELECT symbol, date, len(mean) AS steps, round(mean[1], 4) AS first_step FROM mean_forecasts", "mean_forecasts"),
)
def batch_scoring(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    scorer = fc.trailing_mean_scorer(21)
    early = fc.forecast(requests(p).filter("date < date'1998-01-01'"), scorer, HOR, CTX, "volume")
    out = fc.forecast_panel(requests(p), early, scorer, HOR, CTX, "volume")
    return out.select("symbol", "date", F.size("mean").cast("bigint").alias("steps"), rnd(out["mean"][0], "first_step"))


@query(
    "fc_04_horizon_readouts",
    check_sql(
        """SELECT symbol, date, round(5 * mean, 4) AS five_day, round(q0, 4) AS q0_mean, round(q2, 4) AS q2_last FROM quantile_forecasts""",
        "quantile_forecasts",
    ),
)
def readouts(spark, sf_dir):
    q = quantile_forecasts(market.panel(spark, sf_dir))
    return q.select(
        "symbol",
        "date",
        rnd(fc.mean_sum(5), "five_day"),
        rnd(fc.quantile_mean(0, HOR), "q0_mean"),
        rnd(F.element_at(fc.quantile_path(2, HOR), -1), "q2_last"),
    )


WIDE = tuple(f"Brand#{i}" for i in range(1, 26))


@query(
    "fc_05_wide_forecasts",
    check_sql(
        "SELECT date, "
        + ", ".join(f"round(max(mean[1]) FILTER (symbol = '{s}'), 4) AS \"{s}\"" for s in WIDE)
        + " FROM mean_forecasts GROUP BY date",
        "mean_forecasts",
    ),
)
def wide_forecasts(spark, sf_dir):
    m = mean_forecasts(market.panel(spark, sf_dir))
    flat = m.select("symbol", "date", rnd(m["mean"][0], "level"))
    names = sorted(row["symbol"] for row in market.symbols(spark, sf_dir).collect())
    return fc.forecast_wide(flat, "level", names)


@query(
    "fc_06_coverage",
    check_sql(
        "SELECT round(count(DISTINCT m.date) * 1.0 / count(DISTINCT r.date), 6) AS coverage FROM rebal r LEFT JOIN mean_forecasts m ON m.date = r.date",
        "rebal",
        "mean_forecasts",
    ),
)
def coverage(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    return r4(fc.coverage(mean_forecasts(p), tables.monthly(p)), "coverage", digits=6)


cte(
    "logrets",
    """SELECT * FROM (SELECT symbol, date, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY date) AS r FROM panel)
    WHERE r IS NOT NULL""",
    ("panel",),
)
cte(
    "windows",
    """SELECT * FROM (SELECT symbol, date, list(r) OVER (w ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING) AS win,
    sum(r) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS label, count(r) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n
    FROM logrets WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE len(win) = 32 AND n = 5
    AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
    ("logrets",),
)


def _windows(spark, sf_dir):
    r = log_returns(market.panel(spark, sf_dir).prices)
    return fc.training_windows(r, "logret", 32, 5, "1996-01-01", "2000-12-31")


@query(
    "fc_07_training_windows",
    check_sql(
        "SELECT symbol, date, round(list_sum(win), 6) AS window_sum, round(label, 6) AS label FROM windows", "windows"
    ),
)
def training_windows(spark, sf_dir):
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return _windows(spark, sf_dir).select("symbol", "date", rnd(total, "window_sum", 6), rnd("label", "label", 6))


SAMPLED, SEED = 2_000, 7


@query(
    "fc_07_window_sample",
    check_sql(
        f"""SELECT symbol, date, round(label, 6) AS label FROM windows
        ORDER BY ('0x' || substr(md5('{SEED}:' || symbol || ':' || CAST(date AS VARCHAR)), 1, 15))::BIGINT, symbol, date LIMIT {SAMPLED}""",
        "windows",
    ),
)
def window_sample(spark, sf_dir):
    drawn = fc.sample_windows(materialize(_windows(spark, sf_dir), "windows"), SAMPLED, SEED)
    return drawn.select("symbol", "date", rnd("label", "label", 6))


@query(
    "fc_08_forecast_losses",
    check_sql(
        """SELECT round((avg(greatest(0.1 * (y - q0), -0.9 * (y - q0))) + avg(greatest(0.5 * (y - q1), -0.5 * (y - q1)))
        + avg(greatest(0.9 * (y - q2), -0.1 * (y - q2)))) / 3, 6) AS pinball, round(avg((y - mean) * (y - mean)), 6) AS squared_error FROM (
        SELECT label AS y, 5 * list_avg(win) AS mean, 5 * list_aggregate(win, 'quantile_cont', 0.1) AS q0,
        5 * list_aggregate(win, 'quantile_cont', 0.5) AS q1, 5 * list_aggregate(win, 'quantile_cont', 0.9) AS q2 FROM windows)""",
        "windows",
    ),
)
def losses(spark, sf_dir):
    w = _windows(spark, sf_dir).select("symbol", "date", F.col("window").alias("series"), "label")
    scored = fc.forecast(w, fc.empirical_quantile_scorer([0.1, 0.5, 0.9]), 5, 32, "logret")
    flat = scored.select(
        "symbol", "date", fc.mean_sum(5).alias("mean"), *[(5 * fc.quantile_mean(i, 5)).alias(f"q{i}") for i in range(3)]
    )
    pairs = flat.join(w.select("symbol", "date", F.col("label").alias("y")), ["symbol", "date"])
    return r4(fc.pinball(pairs, [0.1, 0.5, 0.9]), "pinball", "squared_error", digits=6)
