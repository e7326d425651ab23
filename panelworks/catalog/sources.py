"""Source and sink queries. File formats are exercised by staging a derived table as files and reading
it back; the SQL runs on the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelworks.catalog import tables
from panelworks.catalog.base import r4
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.operators.stage import stage_dir
from panelworks.sinks import tables as sink
from panelworks.sources import bars, forecasts, holdings, macro, market, statements as stm


def staged(spark, label: str) -> str:
    return f"{stage_dir(spark)}/panelworks/{label}-{uuid.uuid4().hex}"


# Raw fund holdings per quarter: one line per brand and return flag, lower-case dotted tickers, cash
# lines and weights that do not parse.
cte(
    "raw_holdings",
    """SELECT CAST(date_trunc('quarter', date) AS DATE) AS snapshot_date, ' ' || replace(lower(symbol), '#', '.') AS ticker,
    'Fund line ' || l_returnflag AS name, 'Sector ' || right(symbol, 1) AS sector,
    CASE WHEN sum(l_quantity) % 10 = 3 THEN 'Cash' ELSE 'Equity' END AS asset_class,
    CASE WHEN sum(l_quantity) % 10 <> 4 THEN sum(l_quantity) END AS weight FROM trades
    GROUP BY date_trunc('quarter', date), symbol, l_returnflag""",
    ("trades",),
)
cte(
    "holdings_all",
    """SELECT snapshot_date, ticker, name, sector, weight AS weight_pct, row_number() OVER (PARTITION BY snapshot_date
    ORDER BY weight DESC NULLS LAST, ticker) AS pos FROM (SELECT snapshot_date, replace(upper(trim(ticker)), '.', '-') AS ticker,
    name, sector, weight, row_number() OVER (PARTITION BY snapshot_date, ticker ORDER BY weight DESC NULLS LAST, name) AS rn
    FROM raw_holdings WHERE asset_class = 'Equity') WHERE rn = 1""",
    ("raw_holdings",),
)


def raw_holdings(spark, sf_dir):
    t = market.trades(spark, sf_dir).groupBy(F.trunc("date", "quarter").alias("snapshot_date"), "symbol", "l_returnflag")
    q = F.sum("l_quantity")
    return t.agg(
        F.concat(F.lit(" "), F.translate(F.lower("symbol"), "#", ".")).alias("Ticker"),
        F.concat(F.lit("Fund line "), "l_returnflag").alias("Name"),
        F.concat(F.lit("Sector "), F.right("symbol", F.lit(1))).alias("Sector"),
        F.when(q % 10 == 3, "Cash").otherwise("Equity").alias("Asset Class"),
        F.when(q % 10 != 4, q.cast("string")).otherwise("n/a").alias("Weight (%)"),
    ).select("snapshot_date", *holdings.RAW_COLUMNS)


def _archive(spark, sf_dir, label):
    path = staged(spark, label)
    holdings.write_snapshots(raw_holdings(spark, sf_dir), path)
    return path


@query(
    "src_01_snapshot_history",
    check_sql(
        """SELECT snapshot_date, ticker, name, sector, weight_pct FROM holdings_all WHERE pos <= 15
        UNION ALL SELECT DATE '2002-01-01', ticker, name, sector, weight_pct FROM holdings_all
        WHERE snapshot_date = (SELECT max(snapshot_date) FROM holdings_all)""",
        "holdings_all",
    ),
)
def snapshot_history(spark, sf_dir):
    path = _archive(spark, sf_dir, "snapshots")
    every = holdings.load_snapshots(spark, path)
    current = tables.current_holdings(every)
    return holdings.load_snapshots(spark, path, current, F.lit("2002-01-01").cast("date"), limit=15)


@query(
    "src_02_normalized_holdings",
    check_sql("SELECT snapshot_date, ticker, name, sector, weight_pct FROM holdings_all WHERE pos <= 10", "holdings_all"),
)
def normalized_holdings(spark, sf_dir):
    return holdings.normalize_holdings(raw_holdings(spark, sf_dir), 10, by=["snapshot_date"])


@query(
    "src_03_import_directory",
    check_sql(
        "SELECT snapshot_date, count(*) AS n, sum(weight_pct) AS weight FROM holdings_all GROUP BY 1",
        "holdings_all",
    ),
)
def import_directory(spark, sf_dir):
    source, archive = _archive(spark, sf_dir, "incoming"), staged(spark, "archive")
    before = raw_holdings(spark, sf_dir).filter("snapshot_date < date'1997-01-01'")
    holdings.write_snapshots(holdings.normalize_holdings(before, None, by=["snapshot_date"]), archive)
    added = holdings.import_directory(spark, source, archive)
    holdings.write_snapshots(added, archive)
    lowercase = ["ticker", "name", "sector", "weight_pct"]
    kept = holdings.read_dated_csv(spark, archive, lowercase)
    return kept.groupBy("snapshot_date").agg(
        F.count("*").alias("n"), F.sum(F.col("weight_pct").try_cast("double")).alias("weight")
    )


@query(
    "src_04_write_snapshot",
    check_sql(
        """SELECT DATE '2001-12-31' AS snapshot_date, ticker, name, sector, weight_pct FROM holdings_all
        WHERE snapshot_date = (SELECT max(snapshot_date) FROM holdings_all)""",
        "holdings_all",
    ),
)
def write_snapshot(spark, sf_dir):
    every = holdings.normalize_holdings(raw_holdings(spark, sf_dir), None, by=["snapshot_date"])
    current = tables.current_holdings(every).withColumn("snapshot_date", F.lit("2001-12-31").cast("date"))
    path = staged(spark, "snapshot")
    holdings.write_snapshots(current, path)
    return holdings.load_snapshots(spark, path, columns=["ticker", "name", "sector", "weight_pct"])


@query(
    "src_05_fund_file_body",
    check_sql(
        """SELECT snapshot_date, ticker AS "Ticker", name AS "Name", weight AS weight FROM raw_holdings""",
        "raw_holdings",
    ),
)
def fund_file_body(spark, sf_dir):
    line = F.concat_ws(",", F.concat(F.lit('"'), "Ticker", F.lit('"')), "Name", "Sector", F.col("`Asset Class`"), F.col("`Weight (%)`"))
    body = F.concat_ws("\n", F.array_sort(F.collect_list(line)))
    head = "\ufeffFund Holdings\nAs of,today\n\n" + ",".join(holdings.RAW_COLUMNS) + "\n"
    files = (
        raw_holdings(spark, sf_dir)
        .groupBy("snapshot_date")
        .agg(F.concat(F.lit(head), body, F.lit("\n \nDisclaimer,not a holding\n")).alias("value"))
    )
    path = staged(spark, "fund-files")
    files.repartition("snapshot_date").write.partitionBy("snapshot_date").text(path)
    texts = spark.read.text(path, wholetext=True)
    out = holdings.fund_file_rows(texts, keep=["snapshot_date"])
    return out.select("snapshot_date", "Ticker", "Name", F.col("`Weight (%)`").try_cast("double").alias("weight"))


@query("src_06_dense_panel", check_sql("SELECT * FROM panel", "panel"))
def dense_panel(spark, sf_dir):
    raw = market.bars(spark, sf_dir).toDF("symbol", "Date ", " OPEN", "High", "LOW", "Close", "volume ")
    return bars.assemble_panel(bars.normalize_bars(raw)).prices


@query(
    "src_07_macro_csv",
    """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
    CASE WHEN count(*) <> 1 THEN sum(o_totalprice) END AS value FROM orders GROUP BY 1, 2""",
)
def macro_csv(spark, sf_dir):
    orders = market.table(spark, sf_dir, "orders")
    total = F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("string")
    daily = orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(
        F.when(F.count("*") != 1, total).otherwise(".").alias("value")
    )
    path = staged(spark, "macro")
    daily.repartition("series_id").write.option("header", True).partitionBy("series_id").csv(path)
    return macro.read_series(spark, path, partitioned=True)


cte(
    "wide_years",
    """SELECT symbol, CASE WHEN l_returnflag = 'A' THEN 'Net Income' WHEN l_returnflag = 'N' THEN 'Net Income Common Stockholders'
    ELSE 'Gross Profit' END AS label, year(date) AS y, sum(l_quantity) AS v FROM trades
    WHERE NOT (l_returnflag = 'A' AND CAST(substr(symbol, 7) AS INTEGER) % 3 = 0) GROUP BY ALL""",
    ("trades",),
)


@query(
    "src_08_statement_unpivot",
    check_sql(
        """SELECT g.symbol, g.item, make_date(CAST(y.y AS INTEGER), 12, 31) AS period_end, w.v AS value FROM (
        SELECT symbol, CASE WHEN label = 'Gross Profit' THEN 'gross_profit' ELSE 'net_income' END AS item,
        min(label) AS label FROM wide_years GROUP BY 1, 2) g
        CROSS JOIN (SELECT DISTINCT y FROM wide_years) y
        LEFT JOIN wide_years w ON w.symbol = g.symbol AND w.label = g.label AND w.y = y.y""",
        "wide_years",
    ),
)
def statement_unpivot(spark, sf_dir):
    t = market.trades(spark, sf_dir)
    flag = F.col("l_returnflag")
    label = F.when(flag == "A", "Net Income").when(flag == "N", "Net Income Common Stockholders").otherwise("Gross Profit")
    kept = t.filter(~((flag == "A") & (F.substring("symbol", 7, 9).cast("int") % 3 == 0)))
    wide = (
        kept.withColumn("label", label)
        .withColumn("p", F.concat(F.year("date").cast("string"), F.lit("-12-31")))
        .groupBy("symbol", "label")
        .pivot("p")
        .agg(F.sum("l_quantity"))
        .withColumn("TTM", F.lit(1.0))
    )
    long = stm.unpivot_statement(wide, ["symbol", "label"])
    framed = long.withColumns({"statement": F.lit("income"), "freq": F.lit("annual")})
    return stm.choose_labels(framed, stm.label_table(spark)).drop("freq")


cte(
    "month_volume",
    "SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS date, sum(l_quantity) AS q, count(*) AS n FROM trades GROUP BY 1, 2",
    ("trades",),
)


def month_volume(spark, sf_dir):
    t = market.trades(spark, sf_dir).groupBy("symbol", F.trunc("date", "month").alias("date"))
    return t.agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))


@query("src_09_forecast_panel", check_sql("SELECT symbol, date, [n * 1.0, q] AS mean FROM month_volume", "month_volume"))
def forecast_panel(spark, sf_dir):
    base = month_volume(spark, sf_dir)
    path = staged(spark, "forecasts")
    volume = base.select("symbol", "date", F.array(F.col("n").cast("double"), "q").alias("mean"))
    price = base.select("symbol", "date", F.array("q", F.col("n").cast("double")).alias("mean"))
    forecasts.store(volume, path, 256, 21, "volume", False)
    forecasts.store(price, path, 256, 21, "price", False)
    return forecasts.load(spark, path, 256, 21, "volume", False)


@query(
    "src_10_positions",
    check_sql(
        """SELECT symbol, sum(shares) AS shares FROM (SELECT upper(symbol) AS symbol,
        CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END AS shares FROM trades) GROUP BY 1 HAVING sum(shares) <> 0""",
        "trades",
    ),
)
def positions(spark, sf_dir):
    flag = F.col("l_returnflag")
    text = F.when(flag == "A", F.lower("symbol")).otherwise(F.concat(F.lit(" "), "symbol"))
    shares = F.when(flag == "N", "none").otherwise(F.col("l_quantity").cast("string"))
    rows = market.trades(spark, sf_dir).select(text.alias("Symbol "), shares.alias("Shares"))
    path = staged(spark, "positions")
    rows.write.option("header", True).csv(path)
    return bars.load_positions(spark, path)


@query(
    "src_11_benchmark_close",
    check_sql(
        """SELECT p.date, p.close AS panel_close, round(last_value(e.v IGNORE NULLS) OVER (ORDER BY p.date ROWS UNBOUNDED PRECEDING), 4)
        AS extra_close FROM panel p LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS v FROM orders
        WHERE o_orderstatus = 'F' GROUP BY 1) e ON e.date = p.date WHERE p.symbol = 'Brand#7'""",
        "panel",
    ),
)
def benchmark_close(spark, sf_dir):
    p = market.panel(spark, sf_dir)
    orders = market.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    side = orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))
    extra = bars.extra_close(side, p.sessions).withColumnRenamed("close", "extra_close")
    own = bars.symbol_close(p, "Brand#7").withColumnRenamed("close", "panel_close")
    return r4(own.join(extra, "date"), "extra_close")


@query(
    "snk_03_forecast_upsert",
    check_sql(
        """SELECT 'stored' AS winner, symbol, date, CASE WHEN date < DATE '1999-01-01' THEN q ELSE -q END AS q FROM month_volume
        WHERE date >= DATE '1997-01-01' OR date < DATE '1999-01-01'
        UNION ALL SELECT 'fresh', symbol, date, CASE WHEN date >= DATE '1997-01-01' THEN -q ELSE q END FROM month_volume""",
        "month_volume",
    ),
)
def forecast_upsert(spark, sf_dir):
    base = month_volume(spark, sf_dir).drop("n")
    stored = base.filter("date < date'1999-01-01'")
    fresh = base.filter("date >= date'1997-01-01'").withColumn("q", -F.col("q"))
    keys = ["symbol", "date"]
    a = sink.upsert(stored, fresh, keys, "stored").select(F.lit("stored").alias("winner"), *keys, "q")
    return a.unionByName(sink.upsert(stored, fresh, keys, "fresh").select(F.lit("fresh").alias("winner"), *keys, "q"))
