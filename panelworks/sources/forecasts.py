"""The forecast store: Parquet partitioned by context length, horizon, kind and whether it has quantiles."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PARTITIONS = ("ctx", "hor", "kind", "q")


def _located(frame: DataFrame, ctx: int, hor: int, kind: str, quantiles: bool) -> DataFrame:
    return frame.withColumns(
        {"ctx": F.lit(ctx), "hor": F.lit(hor), "kind": F.lit(kind), "q": F.lit(int(quantiles))}
    )


def store(frame: DataFrame, path: str, ctx: int, hor: int, kind: str, quantiles: bool) -> None:
    """Replace one partition of the store; the others stay."""
    (
        _located(frame, ctx, hor, kind, quantiles)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def load(spark: SparkSession, path: str, ctx: int, hor: int, kind: str, quantiles: bool) -> DataFrame:
    """Rows of one partition; the filter prunes the others before any file is opened. Empty when the
    partition was never written."""
    here = (F.col("ctx") == ctx) & (F.col("hor") == hor) & (F.col("kind") == kind) & (F.col("q") == int(quantiles))
    return spark.read.parquet(path).filter(here).drop(*PARTITIONS)


@dataclass(frozen=True)
class Reading:
    """One number per symbol and date: ``value`` of the rows of one partition."""

    ctx: int
    hor: int
    kind: str
    value: Column
    quantiles: bool = False

    def here(self) -> Column:
        return (
            (F.col("ctx") == self.ctx) & (F.col("hor") == self.hor) & (F.col("kind") == self.kind) & (F.col("q") == int(self.quantiles))
        )


def readings(spark: SparkSession, path: str, wanted: Mapping[str, Reading]) -> DataFrame:
    """(symbol, date, one column per reading): one scan that opens only the partitions asked for, and one aggregation
    that brings the numbers of a symbol and date together. NULL where a partition has no row for them."""
    rows = spark.read.parquet(path).where(reduce(or_, (r.here() for r in wanted.values())))
    cells = rows.select("symbol", "date", *[F.when(r.here(), r.value).alias(name) for name, r in wanted.items()])
    return cells.groupBy("symbol", "date").agg(*[F.max(name).alias(name) for name in wanted])
