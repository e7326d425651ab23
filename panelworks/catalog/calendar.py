"""Calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.catalog import base  # noqa: F401  (shared table expressions)
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.operators import calendar as cal
from panelworks.sources import market


@query(
    "cal_01_first_sessions_of_weeks",
    check_sql(
        """SELECT CAST(isoyear(date) AS BIGINT) AS iso_year, CAST(weekofyear(date) AS BIGINT) AS iso_week,
        min(date) AS date FROM sessions GROUP BY ALL""",
        "sessions",
    ),
)
def first_weeks(spark, sf_dir):
    out = cal.first_sessions_of_weeks(market.sessions(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("iso_year", "iso_week")})


@query(
    "cal_02_first_sessions_of_months",
    check_sql("SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS date FROM sessions GROUP BY 1", "sessions"),
)
def first_months(spark, sf_dir):
    return cal.first_sessions_of_months(market.sessions(spark, sf_dir))


@query(
    "cal_03_rebalance_sessions",
    check_sql(
        """SELECT 'monthly' AS frequency, date FROM rebal UNION ALL SELECT 'weekly', date FROM weekly_first
        UNION ALL SELECT 'biweekly', date FROM (SELECT date, row_number() OVER (ORDER BY date) AS rn FROM weekly_first)
        WHERE rn % 2 = 1""",
        "sessions",
        "rebal",
        "weekly_first",
    ),
)
def rebalances(spark, sf_dir):
    days = market.sessions(spark, sf_dir)
    parts = [
        cal.rebalance_sessions(days, f).select(F.lit(f).alias("frequency"), "date")
        for f in ("monthly", "weekly", "biweekly")
    ]
    return parts[0].union(parts[1]).union(parts[2])


def _order_days(spark, sf_dir):
    return market.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()


ORDER_DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders"


@query(
    "cal_04_is_rebalance",
    check_sql(
        f"""SELECT o.date, o.date IN (SELECT date FROM rebal) AS is_monthly,
        o.date IN (SELECT date FROM weekly_first) AS is_weekly FROM ({ORDER_DAYS}) o""",
        "sessions",
        "rebal",
        "weekly_first",
    ),
)
def is_rebalance(spark, sf_dir):
    days = market.sessions(spark, sf_dir)
    out = cal.is_rebalance(_order_days(spark, sf_dir), cal.rebalance_sessions(days, "monthly"))
    out = out.withColumnRenamed("is_rebalance", "is_monthly")
    out = cal.is_rebalance(out, cal.rebalance_sessions(days, "weekly"))
    return out.withColumnRenamed("is_rebalance", "is_weekly")


@query(
    "cal_05_next_rebalance",
    check_sql(
        f"""SELECT o.date, (SELECT min(s.date) FROM sessions s WHERE s.date >= o.date) AS session,
        (SELECT min(r.date) FROM rebal r WHERE r.date >= o.date) AS next_rebalance FROM ({ORDER_DAYS}) o""",
        "sessions",
        "rebal",
    ),
)
def next_rebalance(spark, sf_dir):
    days = market.sessions(spark, sf_dir)
    out = cal.next_or_same(_order_days(spark, sf_dir), days)
    return cal.next_rebalance(out, days, "monthly")


@query(
    "cal_06_previous_session",
    check_sql(
        f"""SELECT o.date, coalesce((SELECT max(s.date) FROM sessions s WHERE s.date < o.date), o.date) AS prior_end
        FROM ({ORDER_DAYS}) o""",
        "sessions",
    ),
)
def previous_session(spark, sf_dir):
    return cal.previous_session(_order_days(spark, sf_dir), market.sessions(spark, sf_dir))


cte("order_weekdays", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE isodow(o_orderdate) < 6")
cte(
    "extended",
    "SELECT date FROM order_weekdays UNION SELECT date FROM sessions WHERE date > (SELECT max(date) FROM order_weekdays)",
    ("sessions", "order_weekdays"),
)


@query(
    "cal_07_extended_sessions",
    check_sql(
        """SELECT date, date IN (SELECT min(date) FROM extended GROUP BY date_trunc('month', date)) AS is_rebalance
        FROM extended""",
        "extended",
    ),
)
def extended_sessions(spark, sf_dir):
    loaded = _order_days(spark, sf_dir).filter(F.dayofweek("date").between(2, 6))
    ext = cal.extend_sessions(loaded, market.sessions(spark, sf_dir))
    return cal.is_rebalance(ext, cal.rebalance_sessions(ext, "monthly"))


@query(
    "cal_08_month_start_guard",
    check_sql(
        f"""SELECT o.date, f.first_session, o.date IN (SELECT date FROM sessions) AS is_session,
        coalesce(o.date = f.first_session, FALSE) AS go FROM ({ORDER_DAYS}) o LEFT JOIN
        (SELECT date_trunc('month', date) AS m, min(date) AS first_session FROM sessions GROUP BY 1) f
        ON f.m = date_trunc('month', o.date)""",
        "sessions",
    ),
)
def guard(spark, sf_dir):
    return cal.month_start_guard(_order_days(spark, sf_dir), market.sessions(spark, sf_dir))
