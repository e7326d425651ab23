"""Projection and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.catalog import tables
from panelworks.catalog.base import r4
from panelworks.catalog.registry import check_sql, query
from panelworks.settings import TECHNICAL, Setup
from panelworks.functions import scalar
from panelworks.operators import eligibility as elig
from panelworks.operators.indicators import technical_factors
from panelworks.operators.scoring import clean_scores
from panelworks.sources import market


@query(
    "prj_01_normalize_symbol",
    """SELECT DISTINCT raw, CASE upper(replace(replace(trim(raw), '.', '-'), '/', '-')) WHEN 'BRKB' THEN 'BRK-B' WHEN 'BFB' THEN 'BF-B'
    ELSE upper(replace(replace(trim(raw), '.', '-'), '/', '-')) END AS symbol FROM (
    SELECT CASE p_size % 4 WHEN 0 THEN ' brkb ' WHEN 1 THEN 'Bfb' WHEN 2 THEN lower(p_brand) || '.' || p_type
    ELSE p_type || '/' || p_brand || ' ' END AS raw FROM part)""",
)
def normalize_symbol(spark, sf_dir):
    k = F.col("p_size") % 4
    raw = (
        F.when(k == 0, " brkb ")
        .when(k == 1, "Bfb")
        .when(k == 2, F.concat(F.lower("p_brand"), F.lit("."), "p_type"))
        .otherwise(F.concat("p_type", F.lit("/"), "p_brand", F.lit(" ")))
    )
    distinct = market.table(spark, sf_dir, "part").select(raw.alias("raw")).distinct()
    return distinct.select("raw", scalar.normalize_symbol("raw").alias("symbol"))


@query(
    "prj_02_snapshot_date",
    """SELECT DISTINCT stem, CASE WHEN k IN (0, 1) THEN d END AS snapshot_date FROM (SELECT d, k, CASE k
    WHEN 0 THEN 'holdings_' || strftime(d, '%Y-%m-%d') || '_v2' WHEN 1 THEN 'h' || strftime(d, '%Y%m%d')
    WHEN 2 THEN 'fund_' || strftime(d, '%Y') || '9999' ELSE 'undated' END AS stem FROM (
    SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 AS k FROM orders))""",
)
def snapshot_date(spark, sf_dir):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    stem = (
        F.when(k == 0, F.concat(F.lit("holdings_"), F.date_format(day, "yyyy-MM-dd"), F.lit("_v2")))
        .when(k == 1, F.concat(F.lit("h"), F.date_format(day, "yyyyMMdd")))
        .when(k == 2, F.concat(F.lit("fund_"), F.date_format(day, "yyyy"), F.lit("9999")))
        .otherwise("undated")
    )
    stems = market.table(spark, sf_dir, "orders").select(stem.alias("stem")).distinct()
    return stems.select("stem", scalar.snapshot_date("stem").alias("snapshot_date"))


@query(
    "prj_03_panel_subset",
    check_sql(
        """SELECT symbol, count(*) AS sessions, count(close) AS closes, sum(volume) AS volume FROM panel
        WHERE symbol IN (SELECT p_brand FROM part WHERE p_type = 'PROMO' AND p_size > 45) GROUP BY symbol""",
        "panel",
    ),
)
def panel_subset(spark, sf_dir):
    wanted = market.table(spark, sf_dir, "part").filter("p_type = 'PROMO' AND p_size > 45")
    listed = wanted.select(F.col("p_brand").alias("symbol")).distinct()
    kept = market.panel(spark, sf_dir).subset(listed).prices
    return kept.groupBy("symbol").agg(
        F.count("*").alias("sessions"), F.count("close").alias("closes"), F.sum("volume").alias("volume")
    )


@query(
    "prj_04_enough_history",
    check_sql("SELECT symbol, count(close) AS n_close FROM panel GROUP BY symbol HAVING count(close) >= 1093", "panel"),
)
def enough_history(spark, sf_dir):
    return elig.enough_history(market.panel(spark, sf_dir).prices, 1093)


@query(
    "prj_05_study_window",
    check_sql(
        """SELECT *, greatest(requested_start, benchmark_start, membership_start) AS effective_start,
        CAST(requested_start - INTERVAL 4 YEAR AS DATE) AS load_start FROM (
        SELECT CAST(max(o_orderdate) AS DATE) AS requested_end, CAST(CAST(max(o_orderdate) AS DATE) - INTERVAL 5 YEAR AS DATE) AS requested_start FROM orders),
        (SELECT min(date) AS benchmark_start FROM bench WHERE close IS NOT NULL), (SELECT min(date) AS membership_start FROM membership)""",
        "bench",
        "membership",
    ),
)
def study_window(spark, sf_dir):
    ends = market.table(spark, sf_dir, "orders").agg(F.max(F.to_date("o_orderdate")).alias("requested_end"))
    asked = elig.requested_window(ends, lookback_years=5)
    bench = market.benchmark(market.panel(spark, sf_dir).prices)
    return elig.effective_window(asked, bench, tables.membership(spark, sf_dir), train_years=2)


@query("prj_06_base_mask", check_sql("SELECT symbol, date, eligible FROM mask", "mask"))
def base_mask(spark, sf_dir):
    return tables.mask(spark, sf_dir, market.panel(spark, sf_dir))


@query(
    "prj_06_base_mask_with_trend",
    check_sql(
        """SELECT m.symbol, m.date, m.eligible AND coalesce(t.trend_filter > 0 AND t.sma_crossover > 0, FALSE) AS eligible
        FROM mask m JOIN tech_known t USING (symbol, date)""",
        "mask",
        "tech_known",
    ),
)
def base_mask_with_trend(spark, sf_dir):
    p = market.panel(spark, sf_dir)
    trend = tables.tech_known(p, ("sma_crossover", "trend_filter"))
    return elig.base_mask(p.prices, tables.membership(spark, sf_dir), tables.RULES, trend)


@query(
    "prj_07_eligible_symbols",
    check_sql("SELECT symbol, date FROM mask WHERE eligible AND date IN (SELECT date FROM rebal)", "mask", "rebal"),
)
def eligible_symbols(spark, sf_dir):
    p = market.panel(spark, sf_dir)
    ok = elig.eligible_symbols(tables.mask(spark, sf_dir, p))
    return ok.join(F.broadcast(tables.monthly(p)), "date", "left_semi")


@query(
    "prj_08_clean_scores",
    check_sql(
        """SELECT r.date, r.symbol, round(trend_filter + breakout, 6) AS score FROM tech_ranks r JOIN mask m
        ON m.symbol = r.symbol AND m.date = r.date WHERE m.eligible AND trend_filter + breakout > 1e-9""",
        "tech_ranks",
        "mask",
    ),
)
def cleaned_scores(spark, sf_dir):
    p = market.panel(spark, sf_dir)
    raw = tables.tech_ranks(p).select("symbol", "date", (F.col("trend_filter") + F.col("breakout")).alias("score"))
    return r4(clean_scores(raw, tables.mask(spark, sf_dir, p), True).select("date", "symbol", "score"), "score", digits=6)


@query("prj_09_first_float", check_sql("SELECT symbol, shares FROM shares", "shares"))
def first_float(spark, sf_dir):
    keys = ["sharesOutstanding", "impliedSharesOutstanding"]
    return tables.company_info(spark, sf_dir).select("symbol", scalar.first_float("info", keys).alias("shares"))


@query(
    "prj_10_enabled_factors",
    check_sql(
        """SELECT symbol, date, round(sma_crossover, 6) AS sma_crossover, round(breakout, 6) AS breakout FROM (
        SELECT symbol, date, last_value(sma_crossover IGNORE NULLS) OVER u AS sma_crossover, last_value(breakout IGNORE NULLS) OVER u AS breakout
        FROM technicals WINDOW u AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))""",
        "technicals",
    ),
)
def enabled_factors(spark, sf_dir):
    names = Setup(factors=("sma_crossover", "breakout", "avg_dollar_volume")).chosen(TECHNICAL)
    return r4(technical_factors(market.panel(spark, sf_dir), tables.PARAMS, "daily", names), *names, digits=6)


@query(
    "prj_11_primary_window",
    check_sql(
        """SELECT symbol, date FROM mask WHERE eligible AND date IN (SELECT date FROM rebal) AND date >= DATE '1997-01-01'
        AND year(date) < 2001""",
        "mask",
        "rebal",
    ),
)
def primary_window(spark, sf_dir):
    p = market.panel(spark, sf_dir)
    ok = elig.primary_window(elig.eligible_symbols(tables.mask(spark, sf_dir, p)), "1997-01-01", as_of_year=2001)
    return ok.join(F.broadcast(tables.monthly(p)), "date", "left_semi")
