"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.catalog import alignment, fundamentals, tables  # noqa: F401  (shared table expressions)
from panelworks.catalog.base import r4, rnd
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.functions.windows import padded_change
from panelworks.operators import calendar as cal
from panelworks.operators.panel import asof, grid
from panelworks.operators.xsection import top_n
from panelworks.sources import holdings, market


@query("join_01_snapshot_membership", check_sql("SELECT symbol, date FROM membership", "membership"))
def snapshot_membership(spark, sf_dir):
    return tables.membership(spark, sf_dir)


@query(
    "join_01_membership_without_fallback",
    check_sql(
        "SELECT symbol, date FROM membership WHERE date >= (SELECT min(snapshot_date) FROM snapshots)", "membership", "snapshots"
    ),
)
def strict_membership(spark, sf_dir):
    snaps = tables.snapshots(spark, sf_dir)
    days, names = market.sessions(spark, sf_dir), market.symbols(spark, sf_dir)
    return holdings.membership(days, names, snaps, tables.current_holdings(snaps), fallback=False)


@query(
    "join_02_asof_close",
    check_sql(
        """SELECT l.l_orderkey, l.l_linenumber, l.symbol, l.date, p.close FROM (SELECT l_orderkey, l_linenumber, symbol, date
        FROM trades) l ASOF LEFT JOIN (SELECT * FROM panel WHERE close IS NOT NULL) p ON p.symbol = l.symbol AND p.date <= l.date""",
        "trades",
        "panel",
    ),
)
def asof_close(spark, sf_dir):
    targets = market.trades(spark, sf_dir).select("symbol", "date", "l_orderkey", "l_linenumber")
    closes = market.bars(spark, sf_dir).select("symbol", "date", "close")
    per_day = targets.select("symbol", "date").distinct()
    known = asof(per_day, closes, ["close"])
    return targets.join(known, ["symbol", "date"])


@query(
    "join_03_full_outer_add",
    check_sql(
        """SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.date, b.date) AS date,
        round(coalesce(a.x, 0) + coalesce(b.x, 0), 6) AS total FROM
        (SELECT symbol, date, sma_crossover AS x FROM tech_ranks WHERE sma_crossover > 0) a FULL JOIN
        (SELECT symbol, date, breakout AS x FROM tech_ranks WHERE breakout > 0.1) b ON a.symbol = b.symbol AND a.date = b.date""",
        "tech_ranks",
    ),
)
def full_outer_add(spark, sf_dir):
    ranks = tables.tech_ranks(market.panel(spark, sf_dir))
    a = F.when(F.col("sma_crossover") > 0, F.col("sma_crossover"))
    b = F.when(F.col("breakout") > 0.1, F.col("breakout"))
    both = ranks.select("symbol", "date", a.alias("a"), b.alias("b")).filter("a is not null or b is not null")
    total = F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))
    return both.select("symbol", "date", rnd(total, "total", 6))


@query(
    "join_04_screen_metadata",
    check_sql(
        """SELECT s.date, s.symbol, round(s.score, 6) AS score, h.name, h.sector, round(h.weight_pct, 4) AS weight_pct
        FROM scores s LEFT JOIN current_holdings h ON h.ticker = s.symbol""",
        "scores",
        "current_holdings",
    ),
)
def screen_metadata(spark, sf_dir):
    p = market.panel(spark, sf_dir)
    held = tables.current_holdings(tables.snapshots(spark, sf_dir)).withColumnRenamed("ticker", "symbol")
    out = tables.scores(spark, sf_dir, p).join(held, "symbol", "left")
    return r4(r4(out, "score", digits=6), "weight_pct")


@query(
    "join_05_positions_against_targets",
    check_sql(
        """SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.date, b.date) AS date, CASE WHEN b.symbol IS NULL THEN 'SELL'
        WHEN a.symbol IS NULL THEN 'BUY' ELSE 'HOLD' END AS action FROM (SELECT n.date, m.symbol FROM membership m JOIN
        (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM rebal) r ON r.date = m.date JOIN rebal n ON n.date = r.nxt) a
        FULL JOIN (SELECT date, symbol FROM membership WHERE date IN (SELECT date FROM rebal) AND date > (SELECT min(date) FROM rebal)) b
        ON a.symbol = b.symbol AND a.date = b.date""",
        "membership",
        "rebal",
    ),
)
def positions_against_targets(spark, sf_dir):
    days = cal.rebalance_sessions(market.sessions(spark, sf_dir), "monthly")
    near = F.broadcast(cal.neighbours(days))
    members = tables.membership(spark, sf_dir).join(near, "date")
    held = members.filter("next is not null").select("symbol", F.col("next").alias("date"), F.lit(1).alias("held"))
    wanted = members.filter("previous is not null").select("symbol", "date", F.lit(1).alias("wanted"))
    action = F.when(F.col("wanted").isNull(), "SELL").when(F.col("held").isNull(), "BUY").otherwise("HOLD")
    return held.join(wanted, ["symbol", "date"], "full_outer").select("symbol", "date", action.alias("action"))


@query(
    "join_06_returns_with_benchmark",
    check_sql(
        """SELECT c.symbol, c.date, round(c.ret, 6) AS ret, round(b.ret, 6) AS bench_ret FROM changes c JOIN (
        SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM bench) b USING (date)
        WHERE c.ret IS NOT NULL AND b.ret IS NOT NULL""",
        "changes",
        "bench",
    ),
)
def returns_with_benchmark(spark, sf_dir):
    prices = market.panel(spark, sf_dir).prices
    own = prices.select("symbol", "date", rnd(padded_change("close"), "ret", 6)).filter("ret is not null")
    one = market.benchmark(prices).withColumn("_k", F.lit(0))
    bench = one.select("date", rnd(padded_change("close", ["_k"]), "bench_ret", 6)).filter("bench_ret is not null")
    return own.join(F.broadcast(bench), "date")


cte("month_before", "SELECT DISTINCT symbol, date - 30 AS date FROM membership", ("membership",))


@query(
    "join_07_missing_keys",
    check_sql(
        "SELECT s.symbol, s.date FROM scores s LEFT JOIN month_before m ON m.symbol = s.symbol AND m.date = s.date WHERE m.symbol IS NULL",
        "scores",
        "month_before",
    ),
)
def missing_keys(spark, sf_dir):
    later = tables.membership(spark, sf_dir).select("symbol", F.date_sub("date", 30).alias("date"))
    s = tables.scores(spark, sf_dir, market.panel(spark, sf_dir)).select("symbol", "date")
    return s.join(later, ["symbol", "date"], "left_anti")


@query(
    "join_08_cached_keys",
    check_sql(
        "SELECT s.symbol, s.date FROM scores s JOIN month_before m ON m.symbol = s.symbol AND m.date = s.date",
        "scores",
        "month_before",
    ),
)
def cached_keys(spark, sf_dir):
    later = tables.membership(spark, sf_dir).select("symbol", F.date_sub("date", 30).alias("date"))
    s = tables.scores(spark, sf_dir, market.panel(spark, sf_dir)).select("symbol", "date")
    return s.join(later, ["symbol", "date"], "left_semi")


@query("join_09_sessions_by_symbols", check_sql("SELECT symbol, date FROM symbols, sessions", "symbols", "sessions"))
def sessions_by_symbols(spark, sf_dir):
    return grid(market.symbols(spark, sf_dir), market.sessions(spark, sf_dir))


@query(
    "join_10_parameters_by_data",
    check_sql(
        """SELECT n, date, symbol, rank FROM (SELECT n, date, symbol, CAST(row_number() OVER (PARTITION BY n, date ORDER BY score DESC, symbol)
        AS INTEGER) AS rank FROM scores, (VALUES (1), (2), (3)) t(n)) WHERE rank <= n""",
        "scores",
    ),
)
def parameters_by_data(spark, sf_dir):
    grid_of_n = spark.createDataFrame([(1,), (2,), (3,)], "n int")
    s = tables.scores(spark, sf_dir, market.panel(spark, sf_dir)).crossJoin(F.broadcast(grid_of_n))
    return top_n(s, F.col("n"), ["n", "date"]).select("n", "date", "symbol", "rank")
