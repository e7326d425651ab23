"""Macro series: reading, publication lag, standardisation and the composite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelworks.functions.scalar import clean
from panelworks.functions.windows import Mean, rolling, with_rolling_means
from panelworks.operators.panel import align
from panelworks.sources import market

# Series, frequency, and whether a high reading is bad.
SERIES = (
    ("CFNAIDIFF", "monthly", False),
    ("EMVMACROBUS", "monthly", True),
    ("VIXCLS", "daily", True),
    ("VXVCLS", "daily", True),
    ("GVZCLS", "daily", True),
    ("OVXCLS", "daily", True),
    ("DGS10", "daily", True),
    ("T10Y3M", "daily", False),
    ("FEDFUNDS", "monthly", True),
    ("STLFSI4", "weekly", True),
    ("NFCI", "weekly", True),
    ("UMCSENT", "monthly", False),
    ("CFNAI", "monthly", False),
    ("DTWEXBGS", "daily", True),
)
# Calendar days between observation and publication.
PUBLICATION_LAG_DAYS = {"daily": 0, "weekly": 10, "monthly": 45}

META_SCHEMA = "series_id string, frequency string, inverse boolean, lag_days int"


def series_meta(spark: SparkSession, series=SERIES) -> DataFrame:
    rows = [(name, freq, inverse, PUBLICATION_LAG_DAYS[freq]) for name, freq, inverse in series]
    return spark.createDataFrame(rows, META_SCHEMA)


def read_series(spark: SparkSession, path: str, series_id: str | None = None, partitioned: bool = False) -> DataFrame:
    """Date-indexed CSV files: first column the date, second the value; what does not parse as a number
    is NULL. The series is given, or the directory's partition, or else the file name."""
    schema = "date string, value string" + (", series_id string" if partitioned else "")
    raw = spark.read.schema(schema).option("header", True).csv(path)
    if partitioned:
        name = F.col("series_id")
    elif series_id is not None:
        name = F.lit(series_id)
    else:
        name = F.regexp_extract("_metadata.file_name", r"^(.*)\.csv", 1)
    return raw.select(
        name.alias("series_id"),
        F.col("date").try_cast("date").alias("date"),
        clean(F.col("value").try_cast("double")).alias("value"),
    ).filter(F.col("date").isNotNull())


def released(series: DataFrame, meta: DataFrame, sessions: DataFrame) -> DataFrame:
    """Value each session could know: observations move to their release date, the last *row* counts
    even when it is NULL, and inverse series change sign."""
    lagged = series.join(F.broadcast(meta.select("series_id", "lag_days")), "series_id").select(
        "series_id", F.date_add("date", F.col("lag_days")).alias("date"), "value"
    )
    on_sessions = align(lagged, sessions, meta.select("series_id"), ["value"], carry="row")
    sign = F.when(F.col("inverse"), -F.col("value")).otherwise(F.col("value"))
    return on_sessions.join(F.broadcast(meta.select("series_id", "inverse")), "series_id").select(
        "series_id", "date", sign.alias("value")
    )


def standardized(series: DataFrame, meta: DataFrame, sessions: DataFrame, window: int = 252) -> DataFrame:
    need = min(window, max(30, window // 4))
    keys = ("series_id",)
    spread = F.nullif(rolling("value", window, need, F.stddev_samp, keys), F.lit(0.0))
    centred = with_rolling_means(released(series, meta, sessions), {"_mean": Mean("value", window, need)}, keys)
    return centred.select("series_id", "date", ((F.col("value") - F.col("_mean")) / spread).alias("z"))


def composite(z: DataFrame) -> DataFrame:
    """Mean over the series known at each session, NULL while none is."""
    return z.groupBy("date").agg(F.avg("z").alias("macro_composite"))


def known_at_open(composite: DataFrame, out: str = "known_at_open") -> DataFrame:
    """One row per session: the window without partition key runs over the calendar only."""
    return composite.withColumn(out, F.lag("macro_composite").over(Window.orderBy("date")))


# The driver tables as macro data: mean order value per priority.
ORDER_SERIES = (
    ("1-URGENT", "daily", False),
    ("2-HIGH", "weekly", True),
    ("3-MEDIUM", "monthly", False),
    ("4-NOT SPECIFIED", "daily", True),
    ("5-LOW", "monthly", True),
)


def order_meta(spark: SparkSession) -> DataFrame:
    return series_meta(spark, ORDER_SERIES)


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = market.table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(
        F.avg("o_totalprice").alias("value")
    )


def order_composite(spark: SparkSession, sf_dir: str, window: int = 252) -> DataFrame:
    z = standardized(order_series(spark, sf_dir), order_meta(spark), market.sessions(spark, sf_dir), window)
    return composite(z)
