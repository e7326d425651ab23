"""Fund holdings: normalisation, the dated snapshot archive, and point-in-time membership."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelworks.functions.scalar import clean as finite, normalize_symbol, snapshot_date
from panelworks.operators.panel import asof


def normalize_holdings(raw: DataFrame, limit: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(ticker, name, sector, weight_pct): equities only, one row per ticker, heaviest first.

    ``by`` names columns that separate several holdings files in one frame, e.g. the snapshot date.
    """
    names = {c: re.sub(r"\s", "_", c.strip().lower()) for c in raw.columns}
    clean = raw.withColumnsRenamed(names)
    if "asset_class" in clean.columns:
        clean = clean.filter("asset_class = 'Equity'")
    if "ticker" not in clean.columns:
        raise ValueError("holdings need a ticker column")
    if "weight_pct" not in clean.columns and "weight_(%)" in clean.columns:
        clean = clean.withColumnRenamed("weight_(%)", "weight_pct")
    have = set(clean.columns)
    clean = clean.select(
        *by,
        normalize_symbol(F.coalesce("ticker", F.lit(""))).alias("ticker"),
        (F.col("name") if "name" in have else F.lit(None).cast("string")).alias("name"),
        (F.col("sector") if "sector" in have else F.lit(None).cast("string")).alias("sector"),
        (finite(F.col("weight_pct").try_cast("double")) if "weight_pct" in have else F.lit(None).cast("double")).alias("weight_pct"),
    ).filter(~F.col("ticker").isin("", "-"))
    if "name" not in have:
        clean = clean.withColumn("name", F.col("ticker"))
    heaviest = [F.col("weight_pct").desc_nulls_last(), F.col("name"), F.col("sector")]
    first = Window.partitionBy(*by, "ticker").orderBy(*heaviest)
    clean = clean.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    if limit is None:
        return clean
    order = [F.col("weight_pct").desc_nulls_last(), F.col("ticker")]
    if not by:
        return clean.orderBy(*order).limit(limit)
    best = Window.partitionBy(*by).orderBy(*order)
    return clean.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= limit).drop("_rn")


def file_date() -> Column:
    """Date in the file's stem, or in the archive's partition directory."""
    directory = F.regexp_extract("_metadata.file_path", r"snapshot_date=([^/]+)/[^/]+$", 1)
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)
    return F.when(directory != "", snapshot_date(directory)).otherwise(snapshot_date(stem))


def read_dated_csv(spark: SparkSession, path: str, columns: Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """All CSV files under ``path`` with the date each carries; undated files are left out."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
    raw = reader.option("pathGlobFilter", pattern).csv(path)
    return raw.select("*", file_date().alias("snapshot_date")).filter(F.col("snapshot_date").isNotNull())


RAW_COLUMNS = ("Ticker", "Name", "Sector", "Asset Class", "Weight (%)")


def load_snapshots(
    spark: SparkSession,
    path: str,
    current: DataFrame | None = None,
    today: Column | None = None,
    limit: int | None = None,
    columns: Sequence[str] = RAW_COLUMNS,
) -> DataFrame:
    """Snapshot history (snapshot_date, ticker, ...); current holdings count as today's snapshot when
    the archive is older than today."""
    history = normalize_holdings(read_dated_csv(spark, path, columns), limit, by=["snapshot_date"])
    if current is None:
        return history
    today = F.current_date() if today is None else today
    last = history.agg(F.max("snapshot_date").alias("_last"))
    fresh = current.crossJoin(F.broadcast(last)).filter(F.col("_last") < today)
    return history.unionByName(fresh.drop("_last").withColumn("snapshot_date", today))


def write_snapshots(holdings: DataFrame, path: str) -> None:
    """Archive holdings that carry ``snapshot_date``, one directory per date; a date that is written
    again replaces its directory only."""
    (
        holdings.repartition("snapshot_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy("snapshot_date")
        .csv(path)
    )


def archived_dates(spark: SparkSession, path: str) -> DataFrame:
    """Dates already in the archive, from file names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    return files.load(path).select(file_date().alias("snapshot_date")).filter("snapshot_date is not null").distinct()


def import_directory(
    spark: SparkSession,
    source: str,
    archive: str,
    pattern: str = "*.csv",
    overwrite: bool = False,
    columns: Sequence[str] = RAW_COLUMNS,
) -> DataFrame:
    """Normalise every dated file below ``source`` into the archive; dates it already holds are skipped
    unless ``overwrite``. Returns what was imported."""
    incoming = normalize_holdings(read_dated_csv(spark, source, columns, pattern), None, by=["snapshot_date"])
    if not overwrite:
        incoming = incoming.join(F.broadcast(archived_dates(spark, archive)), "snapshot_date", "left_anti")
    return incoming


def fund_file_rows(texts: DataFrame, columns: Sequence[str] = RAW_COLUMNS, keep: Sequence[str] = ()) -> DataFrame:
    """Body of fund files given as whole texts in ``value``: from the line that starts with ``Ticker,``
    to the first blank line, one row per holding. A fund file is as long as its universe."""
    lines = F.split(F.replace("value", F.lit("\ufeff"), F.lit("")), "\r?\n")
    header = F.array_position(F.transform("_lines", lambda x: x.startswith("Ticker,")), F.lit(True)).cast("int")
    blank = F.array_position(F.transform("_tail", lambda x: F.trim(x) == ""), F.lit(True)).cast("int")
    schema = ", ".join(f"`{c}` string" for c in columns)
    return (
        texts.select(*keep, lines.alias("_lines"))
        .withColumn("_header", header)
        .filter("_header > 0")
        .select(*keep, F.slice("_lines", F.col("_header") + 1, F.size("_lines")).alias("_tail"))
        .select(*keep, F.explode(F.when(blank > 0, F.slice("_tail", F.lit(1), blank - 1)).otherwise(F.col("_tail"))).alias("_line"))
        .select(*keep, F.from_csv("_line", schema).alias("_row"))
        .select(*keep, "_row.*")
    )


def combine_metadata(current: DataFrame, history: DataFrame, today: Column | None = None) -> DataFrame:
    """Latest known row per ticker over the archive and the current holdings."""
    today = F.current_date() if today is None else today
    every = history.unionByName(current.withColumn("snapshot_date", today))
    latest = Window.partitionBy("ticker").orderBy(F.col("snapshot_date").desc(), F.col("name"))
    return every.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn", "snapshot_date")


def membership(
    sessions: DataFrame,
    symbols: DataFrame,
    snapshots: DataFrame,
    current: DataFrame | None = None,
    fallback: bool = True,
) -> DataFrame:
    """(symbol, date) pairs: a snapshot is valid until the next one, the last one to the end.

    Sessions are mapped to their snapshot first (two calendar-sized tables), which makes the interval
    join an equi join on the snapshot date. Sessions before the first snapshot use the current holdings
    if ``fallback`` allows, else they have no members.
    """
    dates = snapshots.select(F.col("snapshot_date").alias("date")).distinct()
    one = F.lit(0).alias("_key")
    in_force = asof(
        sessions.select(one, "date"), dates.select(one, "date", F.col("date").alias("snapshot_date")), ["snapshot_date"], "_key"
    ).select("date", "snapshot_date")
    members = snapshots.select("snapshot_date", F.col("ticker").alias("symbol")).distinct()
    out = F.broadcast(in_force).join(members, "snapshot_date").select("symbol", "date")
    if current is not None and fallback:
        early = in_force.filter("snapshot_date is null").select("date")
        out = out.union(current.select(F.col("ticker").alias("symbol")).distinct().crossJoin(F.broadcast(early)))
    return out.join(symbols.select("symbol"), "symbol", "left_semi")


def require_universe(snapshots: DataFrame, fallback: bool) -> None:
    """No snapshots and no permission to fall back on current holdings is an error, not an empty result."""
    if not fallback and snapshots.isEmpty():
        raise ValueError("no holdings snapshots and the current-holdings fallback is disabled")
