"""Cross-section, sorting and set queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from panelworks.catalog import tables
from panelworks.catalog.base import r4, rnd
from panelworks.catalog.registry import check_sql, query
from panelworks.functions.scalar import first_float
from panelworks.functions.windows import running
from panelworks.operators import xsection as xs
from panelworks.sources import market

RETURNS = "(SELECT symbol, date, round(close / open - 1, 3) AS x FROM panel)"


def _returns(spark, sf_dir):
    prices = market.panel(spark, sf_dir).prices
    return prices.select("symbol", "date", rnd(F.try_divide("close", "open") - 1, "x", 3))


@query(
    "xs_01_cross_sectional_rank",
    check_sql(f"SELECT symbol, date, round({tables.rank_sql('x')}, 6) AS rank FROM {RETURNS}", "panel"),
)
def cross_sectional_rank(spark, sf_dir):
    return _returns(spark, sf_dir).select("symbol", "date", rnd(xs.cross_sectional_rank("x"), "rank", 6))


@query(
    "xs_01_wide_cross_section_rank",
    check_sql(f"SELECT symbol, date, round({tables.rank_sql('x', centre='')}, 6) AS rank FROM {RETURNS}", "panel"),
)
def wide_rank(spark, sf_dir):
    return r4(xs.wide_pct_rank(_returns(spark, sf_dir), "x").drop("x"), "rank", digits=6)


@query(
    "xs_02_pct_rank",
    check_sql(
        f"SELECT symbol, date, round(coalesce({tables.rank_sql('x', centre='')}, 0), 6) AS rank FROM {RETURNS}", "panel"
    ),
)
def pct_rank(spark, sf_dir):
    filled = F.coalesce(xs.pct_rank("x"), F.lit(0.0))
    return _returns(spark, sf_dir).select("symbol", "date", rnd(filled, "rank", 6))


@query(
    "xs_03_zscore",
    check_sql(
        """SELECT symbol, date, round(CASE WHEN volume IS NOT NULL THEN coalesce((volume - avg(volume) OVER w)
        / nullif(stddev_samp(volume) OVER w, 0), 0) END, 6) AS z FROM panel WINDOW w AS (PARTITION BY date)""",
        "panel",
    ),
)
def zscore(spark, sf_dir):
    scored = xs.zscore(market.panel(spark, sf_dir).prices.select("symbol", "date", "volume"), "volume")
    return scored.select("symbol", "date", rnd("z", "z", 6))


@query(
    "xs_04_below_quantile",
    check_sql(
        """SELECT p.symbol, p.date, p.volume, coalesce(p.volume < q.cut, FALSE) AS below FROM panel p JOIN (
        SELECT date, quantile_cont(volume, 0.3) AS cut FROM panel GROUP BY date) q USING (date)""",
        "panel",
    ),
)
def below_quantile(spark, sf_dir):
    prices = market.panel(spark, sf_dir).prices.select("symbol", "date", "volume")
    return xs.below_quantile(prices, "volume", 0.3)


@query(
    "xs_05_running_aggregates",
    check_sql(
        """SELECT symbol, date, count(close) OVER w AS n_close, CASE WHEN volume IS NOT NULL THEN sum(volume) OVER w END AS cum_volume,
        CASE WHEN close IS NOT NULL THEN max(close) OVER w END AS high_so_far FROM panel
        WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)""",
        "panel",
    ),
)
def running_aggregates(spark, sf_dir):
    w = running()
    return market.panel(spark, sf_dir).prices.select(
        "symbol",
        "date",
        F.count("close").over(w).alias("n_close"),
        F.when(F.col("volume").isNotNull(), F.sum("volume").over(w)).alias("cum_volume"),
        F.when(F.col("close").isNotNull(), F.max("close").over(w)).alias("high_so_far"),
    )


@query(
    "xs_06_top_n",
    check_sql(
        """SELECT date, symbol, rank, volume FROM (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) AS INTEGER) AS rank
        FROM panel WHERE volume IS NOT NULL) WHERE rank <= 3""",
        "panel",
    ),
)
def top_n(spark, sf_dir):
    traded = market.panel(spark, sf_dir).prices.filter("volume is not null")
    return xs.top_n(traded, 3, score="volume").select("date", "symbol", "rank", "volume")


GAP_SQL = """SELECT date, symbol AS top_symbol, score AS top_score, gap FROM (SELECT *, abs(score - lead(score) OVER w) AS gap,
    row_number() OVER w AS rn FROM scores WINDOW w AS (PARTITION BY date ORDER BY score DESC, symbol)) WHERE rn = 1"""


@query(
    "xs_07_leader_gap",
    check_sql(f"SELECT date, top_symbol, round(top_score, 6) AS top_score, round(gap, 6) AS gap FROM ({GAP_SQL})", "scores"),
)
def leader_gap(spark, sf_dir):
    s = tables.scores(spark, sf_dir, market.panel(spark, sf_dir))
    return r4(xs.leader_gap(s), "top_score", "gap", digits=6)


@query(
    "xs_08_keep_first_and_last",
    check_sql(
        """SELECT ticker, arg_min(snapshot_date, snapshot_date) AS first_date, arg_max(snapshot_date, snapshot_date) AS last_date,
        round(arg_min(weight_pct, snapshot_date), 6) AS first_weight, round(arg_max(weight_pct, snapshot_date), 6) AS last_weight
        FROM snapshots GROUP BY ticker""",
        "snapshots",
    ),
)
def keep_first_and_last(spark, sf_dir):
    snaps = tables.snapshots(spark, sf_dir).select("ticker", "snapshot_date", "weight_pct")
    first = xs.keep_one(snaps, ["ticker"], [F.col("snapshot_date")])
    last = xs.keep_one(snaps, ["ticker"], [F.col("snapshot_date").desc()])
    return first.select("ticker", F.col("snapshot_date").alias("first_date"), rnd("weight_pct", "first_weight", 6)).join(
        last.select("ticker", F.col("snapshot_date").alias("last_date"), rnd("weight_pct", "last_weight", 6)), "ticker"
    )


DAYS = {
    "ship": "SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem",
    "order": "SELECT CAST(o_orderdate AS DATE) AS date FROM orders",
}


def _days(spark, sf_dir):
    ship = market.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    order = market.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    return ship, order


@query("set_01_union_of_indexes", f"{DAYS['ship']} UNION {DAYS['order']}")
def union_of_indexes(spark, sf_dir):
    ship, order = _days(spark, sf_dir)
    return ship.distinct().union(order.distinct()).distinct()


@query("set_02_intersection", f"{DAYS['ship']} INTERSECT {DAYS['order']}")
def intersection(spark, sf_dir):
    ship, order = _days(spark, sf_dir)
    return ship.intersect(order)


@query("set_03_difference", f"{DAYS['ship']} EXCEPT {DAYS['order']}")
def difference(spark, sf_dir):
    ship, order = _days(spark, sf_dir)
    return ship.join(order, "date", "left_anti").distinct()


@query(
    "set_04_ordered_dedup",
    """SELECT symbol, row_number() OVER (ORDER BY pos) AS pos FROM (SELECT symbol, min(pos) AS pos FROM (
    SELECT p_brand AS symbol, p_partkey AS pos FROM part UNION ALL SELECT 'BENCH', 1000000000000) GROUP BY symbol)""",
)
def ordered_dedup(spark, sf_dir):
    part = market.table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("pos"))
    bench = spark.createDataFrame([("BENCH", 10**12)], "symbol string, pos bigint")
    # one row per symbol after the fold, so the numbering window is as small as the universe
    firsts = part.union(bench).groupBy("symbol").agg(F.min("pos").alias("pos"))
    return firsts.select("symbol", F.row_number().over(Window.orderBy("pos")).cast("bigint").alias("pos"))


@query(
    "srt_01_weight_order",
    check_sql(
        """SELECT row_number() OVER (ORDER BY shares DESC NULLS LAST, symbol) AS pos, symbol, shares FROM shares""", "shares"
    ),
)
def weight_order(spark, sf_dir):
    keys = ["sharesOutstanding", "impliedSharesOutstanding"]
    info = tables.company_info(spark, sf_dir).select("symbol", first_float("info", keys).alias("shares"))
    order = Window.orderBy(F.col("shares").desc_nulls_last(), "symbol")
    return info.select(F.row_number().over(order).cast("bigint").alias("pos"), "symbol", "shares")
