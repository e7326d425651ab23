"""Time-series alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.catalog.base import r4, rnd
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.functions.windows import Mean, padded_change, with_rolling_means
from panelworks.operators import calendar as cal
from panelworks.operators import panel as pan
from panelworks.sources import macro, market


@query("ts_01_resample_weekly", check_sql("SELECT * FROM weekly", "weekly"))
def resample_weekly(spark, sf_dir):
    return pan.resample(market.panel(spark, sf_dir), "weekly").prices


@query("ts_01_resample_monthly", check_sql("SELECT * FROM monthly", "monthly"))
def resample_monthly(spark, sf_dir):
    return pan.resample(market.panel(spark, sf_dir), "monthly").prices


# Events: per brand and calendar day (weekends included) the mean discount of flag-R trades, NULL when
# none of the day's trades has that flag.
cte(
    "marks",
    """SELECT symbol, date, avg(l_discount) FILTER (l_returnflag = 'R') AS v, sum(l_tax) FILTER (l_returnflag = 'A') AS u
    FROM trades GROUP BY symbol, date""",
    ("trades",),
)


def marks(spark, sf_dir):
    return (
        market.trades(spark, sf_dir)
        .groupBy("symbol", "date")
        .agg(
            F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_discount"))).alias("v"),
            F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_tax"))).alias("u"),
        )
    )


@query(
    "ts_02_align_last_value",
    check_sql(
        """SELECT g.symbol, g.date, round(a.v, 6) AS v, round(b.u, 6) AS u
        FROM (SELECT symbol, date FROM symbols, sessions) g
        ASOF LEFT JOIN (SELECT * FROM marks WHERE v IS NOT NULL) a ON a.symbol = g.symbol AND a.date <= g.date
        ASOF LEFT JOIN (SELECT * FROM marks WHERE u IS NOT NULL) b ON b.symbol = g.symbol AND b.date <= g.date""",
        "symbols",
        "sessions",
        "marks",
    ),
)
def align_value(spark, sf_dir):
    out = pan.align(marks(spark, sf_dir), market.sessions(spark, sf_dir), market.symbols(spark, sf_dir), ["v", "u"])
    return r4(out, "v", "u", digits=6)


@query(
    "ts_03_align_last_row",
    check_sql(
        """SELECT g.symbol, g.date, round(a.v, 6) AS v, round(a.u, 6) AS u
        FROM (SELECT symbol, date FROM symbols, sessions) g
        ASOF LEFT JOIN marks a ON a.symbol = g.symbol AND a.date <= g.date""",
        "symbols",
        "sessions",
        "marks",
    ),
)
def align_row(spark, sf_dir):
    days, names = market.sessions(spark, sf_dir), market.symbols(spark, sf_dir)
    return r4(pan.align(marks(spark, sf_dir), days, names, ["v", "u"], carry="row"), "v", "u", digits=6)


@query(
    "ts_04_lag_for_open",
    check_sql(
        """SELECT symbol, date, lag(close) OVER w AS close, lag(volume) OVER w AS volume FROM panel
        WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
        "panel",
    ),
)
def lag_open(spark, sf_dir):
    prices = market.panel(spark, sf_dir).prices.select("symbol", "date", "close", "volume")
    return pan.lag_for_open(prices, ["close", "volume"])


# Macro series: mean order value per order priority, with their frequencies and publication lags.
cte(
    "macro_meta",
    """SELECT * FROM (VALUES ('1-URGENT', 0, FALSE), ('2-HIGH', 10, TRUE), ('3-MEDIUM', 45, FALSE),
    ('4-NOT SPECIFIED', 0, TRUE), ('5-LOW', 45, TRUE)) t(series_id, lag_days, inverse)""",
)
cte(
    "macro_series",
    """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value
    FROM orders GROUP BY 1, 2""",
)
cte(
    "macro_aligned",
    """SELECT g.series_id, g.date, CASE WHEN g.inverse THEN -m.value ELSE m.value END AS value
    FROM (SELECT * FROM macro_meta, sessions) g
    ASOF LEFT JOIN (SELECT series_id, date + lag_days AS date, value FROM macro_series JOIN macro_meta USING (series_id)) m
    ON m.series_id = g.series_id AND m.date <= g.date""",
    ("macro_meta", "macro_series", "sessions"),
)
cte(
    "macro_z",
    """SELECT series_id, date, CASE WHEN count(value) OVER w >= 63 THEN
    (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) END AS z FROM macro_aligned
    WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 251 PRECEDING)""",
    ("macro_aligned",),
)
cte(
    "macro_composite",
    "SELECT date, avg(z) AS macro_composite FROM macro_z GROUP BY date",
    ("macro_z",),
)


@query(
    "ts_05_publication_lag",
    check_sql("SELECT series_id, date, round(value, 4) AS value FROM macro_aligned", "macro_aligned"),
)
def publication_lag(spark, sf_dir):
    out = macro.released(macro.order_series(spark, sf_dir), macro.order_meta(spark), market.sessions(spark, sf_dir))
    return r4(out, "value")


@query("ts_06_rolling_zscore", check_sql("SELECT series_id, date, round(z, 4) AS z FROM macro_z", "macro_z"))
def macro_zscore(spark, sf_dir):
    out = macro.standardized(macro.order_series(spark, sf_dir), macro.order_meta(spark), market.sessions(spark, sf_dir))
    return r4(out, "z")


@query(
    "ts_07_macro_composite",
    check_sql(
        """SELECT date, round(macro_composite, 4) AS macro_composite,
        round(lag(macro_composite) OVER (ORDER BY date), 4) AS known_at_open FROM macro_composite""",
        "macro_composite",
    ),
)
def macro_composite(spark, sf_dir):
    out = macro.order_composite(spark, sf_dir)
    return r4(macro.known_at_open(out), "macro_composite", "known_at_open")


@query(
    "ts_08_log_returns",
    check_sql(
        """SELECT symbol, date, round(ln(close) - lag(ln(close)) OVER w, 6) AS logret,
        round(ln(greatest(volume, 1)) - lag(ln(greatest(volume, 1))) OVER w, 6) AS logvol
        FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
        "panel",
    ).replace("greatest(volume, 1)", "CASE WHEN volume IS NOT NULL THEN greatest(volume, 1) END"),
)
def log_returns(spark, sf_dir):
    prices = market.panel(spark, sf_dir).prices.select("symbol", "date", "close", "volume")
    out = pan.log_returns(pan.log_returns(prices), "volume", "logvol")
    return r4(out.drop("close", "volume"), "logret", "logvol", digits=6)


cte(
    "filled",
    """SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
    ROWS UNBOUNDED PRECEDING) AS close FROM panel""",
    ("panel",),
)
cte(
    "changes",
    """SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM filled""",
    ("filled",),
)


@query("ts_09_padded_change", check_sql("SELECT symbol, date, round(ret, 6) AS ret FROM changes", "changes"))
def changes(spark, sf_dir):
    prices = market.panel(spark, sf_dir).prices
    return prices.select("symbol", "date", rnd(padded_change("close"), "ret", 6))


cte(
    "forward",
    """SELECT symbol, date, lead(open) OVER (PARTITION BY symbol ORDER BY date) / open - 1 AS forward_return
    FROM panel WHERE date IN (SELECT date FROM rebal)""",
    ("panel", "rebal"),
)


@query(
    "ts_10_forward_open_returns",
    check_sql("SELECT symbol, date, round(forward_return, 6) AS forward_return FROM forward", "forward"),
)
def forward(spark, sf_dir):
    p = market.panel(spark, sf_dir)
    out = pan.forward_open_returns(p.prices, cal.rebalance_sessions(p.sessions, "monthly"))
    return r4(out, "forward_return", digits=6)


@query(
    "ts_11_trailing_volume_at_prior_end",
    check_sql(
        """SELECT v.symbol, r.date, r.prior_end, round(v.tv, 4) AS trailing_volume FROM rebal_prior r JOIN (
        SELECT symbol, date, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) AS tv FROM panel) v
        ON v.date = r.prior_end""",
        "rebal_prior",
        "panel",
    ),
)
def trailing_volume(spark, sf_dir):
    p = market.panel(spark, sf_dir)
    tv = with_rolling_means(p.prices.select("symbol", "date", "volume"), {"trailing_volume": Mean("volume", 21, 1)})
    dates = cal.previous_session(cal.rebalance_sessions(p.sessions, "monthly"), p.sessions)
    out = pan.at_prior_end(tv, dates)
    return r4(out.select("symbol", "date", "prior_end", "trailing_volume"), "trailing_volume")
