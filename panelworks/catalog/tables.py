"""Holdings, statements, positions, factor ranks and scores derived from the driver tables, in Spark and
in the check SQL, for the queries that need them as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelworks.catalog import base  # noqa: F401  (shared table expressions)
from panelworks.catalog.registry import cte
from panelworks.settings import Eligible, Lookbacks
from panelworks.operators import calendar as cal
from panelworks.operators import fundamentals as fnd
from panelworks.operators.eligibility import base_mask
from panelworks.operators.indicators import technical_factors
from panelworks.operators.panel import Panel, lag_for_open
from panelworks.operators.stage import materialize
from panelworks.operators.xsection import cross_sectional_rank
from panelworks.sources import holdings, market, statements as stm

# --- holdings: the twenty brands with the largest quantity of a quarter, known when the next one starts

cte(
    "quarter_quantity",
    """SELECT CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH AS DATE) AS snapshot_date, symbol AS ticker,
    sum(l_quantity) AS q FROM trades GROUP BY 1, 2""",
    ("trades",),
)
cte(
    "snapshots",
    """SELECT snapshot_date, ticker, 'Name of ' || ticker AS name, 'S' || right(ticker, 1) AS sector,
    100 * q / total AS weight_pct FROM (SELECT *, sum(q) OVER (PARTITION BY snapshot_date) AS total,
    count(*) OVER (PARTITION BY snapshot_date) AS names FROM quarter_quantity) WHERE q * names >= 0.85 * total""",
    ("quarter_quantity",),
)
cte("current_holdings", "SELECT * EXCLUDE (snapshot_date) FROM snapshots WHERE snapshot_date = (SELECT max(snapshot_date) FROM snapshots)", ("snapshots",))
cte(
    "membership",
    """SELECT x.ticker AS symbol, s.date FROM (SELECT date, (SELECT max(snapshot_date) FROM snapshots
    WHERE snapshot_date <= sessions.date) AS valid FROM sessions) s JOIN snapshots x ON x.snapshot_date = s.valid
    UNION ALL SELECT c.ticker, s.date FROM sessions s, current_holdings c
    WHERE s.date < (SELECT min(snapshot_date) FROM snapshots)""",
    ("sessions", "snapshots", "current_holdings"),
)


def snapshots(spark, sf_dir, by: str = "brand", least: float = 0.85) -> DataFrame:
    """Quarterly holdings: every name that traded at least ``least`` times the quarter's mean quantity."""
    quarter = F.add_months(F.trunc("date", "quarter"), 3)
    q = market.trades(spark, sf_dir, by).groupBy(quarter.alias("snapshot_date"), F.col("symbol").alias("ticker"))
    q = q.agg(F.sum("l_quantity").alias("q"))
    totals = q.groupBy("snapshot_date").agg(F.sum("q").alias("total"), F.count("*").alias("names"))
    return (
        q.join(F.broadcast(totals), "snapshot_date")
        .filter(F.col("q") * F.col("names") >= least * F.col("total"))
        .select(
            "snapshot_date",
            "ticker",
            F.concat(F.lit("Name of "), "ticker").alias("name"),
            F.concat(F.lit("S"), F.right("ticker", F.lit(1))).alias("sector"),
            (100 * F.col("q") / F.col("total")).alias("weight_pct"),
        )
    )


def current_holdings(snaps: DataFrame) -> DataFrame:
    last = snaps.agg(F.max("snapshot_date").alias("snapshot_date"))
    return snaps.join(F.broadcast(last), "snapshot_date", "left_semi").drop("snapshot_date")


def membership(spark, sf_dir, by: str = "brand") -> DataFrame:
    snaps = snapshots(spark, sf_dir, by)
    days, names = market.sessions(spark, sf_dir), market.symbols(spark, sf_dir, by)
    return holdings.membership(days, names, snaps, current_holdings(snaps))


# --- statements: sums of trades per brand and quarter (or year) under the statement labels

STATEMENT_LINES = """('balance', 'Total Assets', CASE WHEN n % 11 <> 0 THEN ext END),
    ('balance', CASE WHEN even THEN 'Common Stock Equity' ELSE 'Stockholders Equity' END, ext - disc),
    ('income', 'Net Income', CASE WHEN n % 7 <> 0 THEN disc - 0.04 * ext END), ('income', 'Gross Profit', tax),
    ('cashflow', 'Operating Cash Flow', tax - 0.02 * ext), ('cashflow', 'Capital Expenditure', -10 * qty),
    ('cashflow', 'Issuance Of Capital Stock', n_qty), ('cashflow', 'Repurchase Of Capital Stock', -r_qty)"""
STACKED_LINES = STATEMENT_LINES.replace("('", "'").replace("),", ",").removesuffix(")")
cte(
    "period_sums",
    """SELECT symbol, freq, CAST(period_end AS DATE) AS period_end, CAST(substr(symbol, 7) AS INTEGER) % 2 = 0 AS even,
    count(*) AS n, sum(l_extendedprice) AS ext, sum(l_extendedprice * l_discount) AS disc,
    sum(l_extendedprice * l_tax) AS tax, sum(l_quantity) AS qty, sum(l_quantity) FILTER (l_returnflag = 'N') AS n_qty,
    sum(l_quantity) FILTER (l_returnflag = 'R') AS r_qty FROM (
    SELECT *, 'quarterly' AS freq, date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS period_end FROM trades
    UNION ALL SELECT *, 'annual', date_trunc('year', date) + INTERVAL 12 MONTH - INTERVAL 1 DAY FROM trades)
    GROUP BY 1, 2, 3""",
    ("trades",),
)
cte(
    "statements",
    f"""SELECT symbol, freq, period_end, col0 AS statement, col1 AS label, col2 AS value FROM period_sums,
    LATERAL (VALUES {STATEMENT_LINES}) t(col0, col1, col2)""",
    ("period_sums",),
)
cte(
    "chosen",
    """SELECT symbol, freq, CASE label WHEN 'Total Assets' THEN 'assets' WHEN 'Stockholders Equity' THEN 'equity'
    WHEN 'Common Stock Equity' THEN 'equity' WHEN 'Net Income' THEN 'net_income' WHEN 'Gross Profit' THEN 'gross_profit'
    WHEN 'Operating Cash Flow' THEN 'operating_cash_flow' WHEN 'Capital Expenditure' THEN 'capex'
    WHEN 'Issuance Of Capital Stock' THEN 'issuance' ELSE 'repurchase' END AS item, period_end, value FROM statements""",
    ("statements",),
)
cte("statement_dates", "SELECT DISTINCT symbol, period_end FROM statements", ("statements",))
cte(
    "company_info",
    """SELECT p_brand AS symbol, CASE WHEN sum(p_size) % 3 = 0 THEN 'n/a' ELSE CAST(sum(p_size) AS VARCHAR) END AS s1,
    CASE WHEN sum(p_size) % 5 <> 0 THEN CAST(sum(p_size) + 1 AS VARCHAR) END AS s2 FROM part GROUP BY 1""",
)
cte(
    "shares",
    "SELECT symbol, coalesce(TRY_CAST(s1 AS DOUBLE), TRY_CAST(s2 AS DOUBLE)) AS shares FROM company_info",
    ("company_info",),
)
cte(
    "earnings",
    """SELECT symbol, max(date) AS date, CASE WHEN count(*) % 5 <> 0 THEN avg(l_discount) - 0.05 END AS surprise FROM trades
    GROUP BY symbol, date_trunc('month', date)""",
    ("trades",),
)


def statements(spark, sf_dir, by: str = "brand") -> DataFrame:
    t = market.trades(spark, sf_dir, by)
    ends = F.array(
        F.struct(F.lit("quarterly").alias("freq"), F.date_sub(F.add_months(F.trunc("date", "quarter"), 3), 1).alias("period_end")),
        F.struct(F.lit("annual").alias("freq"), F.date_sub(F.add_months(F.trunc("date", "year"), 12), 1).alias("period_end")),
    )
    flag = F.col("l_returnflag")
    sums = (
        t.groupBy("symbol", F.trunc("date", "quarter").alias("date"))
        .agg(
            F.count("*").alias("n"),
            F.sum("l_extendedprice").alias("ext"),
            F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("disc"),
            F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
            F.sum("l_quantity").alias("qty"),
            F.sum(F.when(flag == "N", F.col("l_quantity"))).alias("n_qty"),
            F.sum(F.when(flag == "R", F.col("l_quantity"))).alias("r_qty"),
        )
        .select("*", F.explode(ends).alias("p"))
        .groupBy("symbol", "p.freq", "p.period_end")
        .agg(*[F.sum(c).alias(c) for c in ("n", "ext", "disc", "tax", "qty", "n_qty", "r_qty")])
        .withColumn("even", F.coalesce(F.substring("symbol", 7, 9).try_cast("int"), F.lit(0)) % 2 == 0)
    )
    return sums.selectExpr("symbol", "freq", "period_end", f"stack(8, {STACKED_LINES}) AS (statement, label, value)")


def company_info(spark, sf_dir) -> DataFrame:
    s = market.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.sum("p_size").alias("s"))
    first = F.when(F.col("s") % 3 == 0, "n/a").otherwise(F.col("s").cast("string"))
    second = F.when(F.col("s") % 5 != 0, (F.col("s") + 1).cast("string"))
    return s.select(
        "symbol", F.create_map(F.lit("sharesOutstanding"), first, F.lit("impliedSharesOutstanding"), second).alias("info")
    )


def earnings(spark, sf_dir, by: str = "brand") -> DataFrame:
    t = market.trades(spark, sf_dir, by).groupBy("symbol", F.trunc("date", "month").alias("m"))
    surprise = F.when(F.count("*") % 5 != 0, F.avg("l_discount") - 0.05)
    return t.agg(F.max("date").alias("date"), surprise.alias("surprise")).drop("m")


def records(spark, sf_dir, prices: DataFrame, lag_days: int = 45, names=None, by: str = "brand") -> DataFrame:
    rows = statements(spark, sf_dir, by)
    chosen = stm.choose_labels(rows, stm.label_table(spark))
    args = (chosen, rows.select("symbol", "period_end"), prices, company_info(spark, sf_dir), earnings(spark, sf_dir, by))
    return fnd.fundamental_records(*args, lag_days, *([names] if names else []))


# --- factor ranks, eligibility and a plain equal-weight score at the monthly rebalances

RULES = Eligible(sessions=60, price=500.0, dollar_volume=60_000.0)
PARAMS = Lookbacks(averages=(10, 30), trend=60)
TECH = ("sma_crossover", "trend_filter", "breakout")
FUND = ("asset_growth", "earnings_yield", "roa")

cte(
    "mask",
    """SELECT p.symbol, p.date, m.symbol IS NOT NULL AND coalesce(lag(h >= 60) OVER w, FALSE)
    AND coalesce(lag(close >= 500) OVER w, FALSE) AND coalesce(lag(adv >= 60000, 2) OVER w, FALSE) AS eligible FROM (
    SELECT symbol, date, close, count(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS h,
    CASE WHEN count(close * volume) OVER v >= 10 THEN avg(close * volume) OVER v END AS adv FROM panel
    WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)) p
    LEFT JOIN membership m ON m.symbol = p.symbol AND m.date = p.date
    WINDOW w AS (PARTITION BY p.symbol ORDER BY p.date)""",
    ("panel", "membership"),
)
cte(
    "technicals",
    """SELECT symbol, date, (f - s) / nullif(s, 0) AS sma_crossover, (close - t) / nullif(t, 0) AS trend_filter,
    close / nullif(hi, 0) - 1 AS breakout FROM (SELECT symbol, date, close,
    CASE WHEN count(close) OVER a >= 5 THEN avg(close) OVER a END AS f,
    CASE WHEN count(close) OVER b >= 15 THEN avg(close) OVER b END AS s,
    CASE WHEN count(close) OVER c >= 30 THEN avg(close) OVER c END AS t,
    CASE WHEN count(high) OVER d >= 13 THEN max(high) OVER d END AS hi FROM panel
    WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING), b AS (PARTITION BY symbol ORDER BY date ROWS 29 PRECEDING),
    c AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), d AS (PARTITION BY symbol ORDER BY date ROWS 25 PRECEDING))""",
    ("panel",),
)
cte(
    "tech_known",
    """SELECT symbol, date, lag(sma_crossover) OVER w AS sma_crossover, lag(trend_filter) OVER w AS trend_filter,
    lag(breakout) OVER w AS breakout FROM (SELECT symbol, date, last_value(sma_crossover IGNORE NULLS) OVER u AS sma_crossover,
    last_value(trend_filter IGNORE NULLS) OVER u AS trend_filter, last_value(breakout IGNORE NULLS) OVER u AS breakout
    FROM technicals WINDOW u AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))
    WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    ("technicals",),
)


def rank_sql(x: str, keys: str = "date", centre: str = " - 0.5") -> str:
    return f"""CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {x} NULLS LAST)
    + (count({x}) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {keys}){centre} END"""


cte(
    "tech_ranks",
    f"""SELECT symbol, date, {', '.join(f'{rank_sql(f)} AS {f}' for f in TECH)} FROM tech_known
    WHERE date IN (SELECT date FROM rebal)""",
    ("tech_known", "rebal"),
)
cte(
    "scores",
    """SELECT r.date, r.symbol, (coalesce(sma_crossover, 0) + coalesce(trend_filter, 0) + coalesce(breakout, 0)) / 3 AS score
    FROM tech_ranks r JOIN mask m ON m.symbol = r.symbol AND m.date = r.date WHERE m.eligible
    AND (coalesce(sma_crossover, 0) + coalesce(trend_filter, 0) + coalesce(breakout, 0)) / 3 > 1e-9""",
    ("tech_ranks", "mask"),
)


def monthly(p: Panel) -> DataFrame:
    return cal.rebalance_sessions(p.sessions, "monthly")


def prior_ends(p: Panel) -> DataFrame:
    return cal.previous_session(monthly(p), p.sessions)


def mask(spark, sf_dir, p: Panel) -> DataFrame:
    return base_mask(p.prices, membership(spark, sf_dir), RULES)


def tech_known(p: Panel, names=TECH) -> DataFrame:
    return lag_for_open(technical_factors(p, PARAMS, "daily", names), list(names))


def tech_ranks(p: Panel) -> DataFrame:
    at = tech_known(p).join(F.broadcast(monthly(p)), "date", "left_semi")
    return at.select("symbol", "date", *[cross_sectional_rank(f).alias(f) for f in TECH])


def scores(spark, sf_dir, p: Panel) -> DataFrame:
    """(date, symbol, score): mean technical rank of the eligible symbols, where positive."""
    total = sum((F.coalesce(f, F.lit(0.0)) for f in TECH[1:]), F.coalesce(TECH[0], F.lit(0.0)))
    ok = mask(spark, sf_dir, p).filter("eligible").select("symbol", "date")
    # ranks cancel to about 1e-17 instead of 0, hence the small threshold
    return (
        tech_ranks(p)
        .join(ok, ["symbol", "date"], "left_semi")
        .select("date", "symbol", (total / 3).alias("score"))
        .filter("score > 1e-9")
    )


def stored_scores(spark, sf_dir, p: Panel) -> DataFrame:
    """Scores written out, for queries that read them several times."""
    return materialize(scores(spark, sf_dir, p), "scores")
