"""Table expressions and small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelworks.catalog.registry import cte


def r4(frame: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Round the named columns, so that summation order cannot show in the comparison."""
    return frame.withColumns({c: F.round(F.col(c), digits) for c in columns})


def rnd(c: Column | str, name: str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name)


# A trade belongs to the session of its day; one on a weekend to that of the Monday after.
SESSION_OF = "CAST({0} AS DATE) + CASE isodow({0}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END"
cte("sessions", f"SELECT DISTINCT {SESSION_OF.format('l_shipdate')} AS date FROM lineitem")
cte("symbols", "SELECT DISTINCT p_brand AS symbol FROM part")
cte(
    "trades",
    """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_orderkey, l_linenumber
    FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
cte(
    "bars",
    f"""SELECT symbol, session AS date, first(px ORDER BY l_orderkey, l_linenumber, px) AS open, max(px) AS high,
    min(px) AS low, last(px ORDER BY l_orderkey, l_linenumber, px) AS close, sum(l_quantity) AS volume
    FROM (SELECT *, {SESSION_OF.format('date')} AS session FROM trades) GROUP BY symbol, session""",
    ("trades",),
)
cte(
    "panel",
    """SELECT s.symbol, d.date, b.open, b.high, b.low, b.close, b.volume FROM symbols s CROSS JOIN sessions d
    LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = d.date""",
    ("symbols", "sessions", "bars"),
)
cte("weekly_first", "SELECT min(date) AS date FROM sessions GROUP BY isoyear(date), weekofyear(date)", ("sessions",))
cte("rebal", "SELECT min(date) AS date FROM sessions GROUP BY date_trunc('month', date)", ("sessions",))
cte(
    "rebal_prior",
    """SELECT r.date, coalesce((SELECT max(s.date) FROM sessions s WHERE s.date < r.date), r.date) AS prior_end
    FROM rebal r""",
    ("rebal", "sessions"),
)
cte("bench", "SELECT date, sum(close * volume) / sum(volume) AS close FROM panel GROUP BY date", ("panel",))
cte(
    "weekly",
    """SELECT g.symbol, g.date, arg_min(p.open, p.date) FILTER (p.open IS NOT NULL) AS open, max(p.high) AS high,
    min(p.low) AS low, arg_max(p.close, p.date) FILTER (p.close IS NOT NULL) AS close,
    coalesce(sum(p.volume), 0) AS volume
    FROM (SELECT symbol, unnest(labels) AS date FROM symbols, (SELECT generate_series(
        min(date + CAST((12 - isodow(date)) % 7 AS INTEGER)), max(date + CAST((12 - isodow(date)) % 7 AS INTEGER)),
        INTERVAL 7 DAY)::DATE[] AS labels FROM sessions)) g
    LEFT JOIN panel p ON p.symbol = g.symbol AND p.date + CAST((12 - isodow(p.date)) % 7 AS INTEGER) = g.date
    GROUP BY g.symbol, g.date""",
    ("symbols", "sessions", "panel"),
)
cte(
    "monthly",
    """SELECT g.symbol, last_day(g.m) AS date, arg_min(p.open, p.date) FILTER (p.open IS NOT NULL) AS open,
    max(p.high) AS high, min(p.low) AS low, arg_max(p.close, p.date) FILTER (p.close IS NOT NULL) AS close,
    coalesce(sum(p.volume), 0) AS volume
    FROM (SELECT symbol, unnest(months) AS m FROM symbols, (SELECT generate_series(
        date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)::DATE[] AS months FROM sessions)) g
    LEFT JOIN panel p ON p.symbol = g.symbol AND date_trunc('month', p.date) = g.m
    GROUP BY g.symbol, g.m""",
    ("symbols", "sessions", "panel"),
)
