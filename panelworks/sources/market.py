"""The driver tables seen as a market, so that every operator has inputs that grow with the tables.

``lineitem`` rows are trades: the ship date is the session, the brand of the part (or the supplier) is
the symbol, unit price is the price and quantity the volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelworks.operators.panel import Panel, densify
from panelworks.operators.stage import materialize


# Declared, so that opening a table starts no schema-inference job.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def session_of(day: Column) -> Column:
    """The session a trade belongs to: its own weekday, or the Monday after a weekend. No trade is left out."""
    return F.date_add(day, F.when(F.dayofweek(day) == 7, 2).when(F.dayofweek(day) == 1, 1).otherwise(0))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that have a trade: a one-column scan with map-side distinct."""
    return table(spark, sf_dir, "lineitem").select(session_of(F.to_date("l_shipdate")).alias("date")).distinct()


def symbols(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    if by == "brand":
        return table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))


def trades(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        "l_suppkey",
        F.to_date("l_shipdate").alias("date"),
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
    )
    if by == "brand":
        part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
        li = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    else:
        li = li.withColumn("symbol", F.col("l_suppkey").cast("string"))
    return li.withColumn("px", F.try_divide("l_extendedprice", "l_quantity"))


def bars(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Daily bars from all trades. Trades are ordered by (order, line), the key of the table; the two are packed into
    one decimal that holds any of their values, so Spark keeps to hash aggregation."""
    seq = F.col("l_orderkey").cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)")
    seq = seq + F.col("l_linenumber").cast("decimal(10,0)")
    t = trades(spark, sf_dir, by).select("symbol", session_of(F.col("date")).alias("date"), "px", "l_quantity", seq.alias("seq"))
    return t.groupBy("symbol", "date").agg(
        F.min_by("px", "seq").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "seq").alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def panel(spark: SparkSession, sf_dir: str, by: str = "brand") -> Panel:
    return densify(bars(spark, sf_dir, by), sessions(spark, sf_dir), symbols(spark, sf_dir, by))


def stored_panel(spark: SparkSession, sf_dir: str, by: str = "brand") -> Panel:
    """Panel written out once, for analyses that read it from several places: ingest, aggregation and
    densification then run once instead of once per use."""
    p = panel(spark, sf_dir, by)
    prices = materialize(p.prices, "panel")
    return Panel(prices, materialize(p.sessions, "sessions"), materialize(p.symbols, "symbols"))


def benchmark(prices: DataFrame) -> DataFrame:
    """Volume-weighted close of all symbols per session."""
    return prices.groupBy("date").agg(
        F.try_divide(F.sum(F.col("close") * F.col("volume")), F.sum("volume")).alias("close")
    )
