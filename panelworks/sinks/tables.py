"""Run outputs, append-only logs and keyed upserts as plain Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType


MANIFEST = "version long, output string, path string, rows long"


def publish_run(path: str, **outputs: DataFrame) -> int:
    """Write several outputs of a run so that readers see all of them or none; returns the new version.

    Every output goes to a folder of its own under a fresh name, and its rows are counted while they are written. The
    manifest, one small file of all outputs' places, is written last: a version exists once its manifest does. A run
    that dies before leaves unread folders and the version before in force. One run publishes at a time.
    """
    spark = next(iter(outputs.values())).sparkSession
    rows = []
    token = uuid.uuid4().hex
    for name, frame in outputs.items():
        counted = Observation(f"{name}-{token}")
        place = f"{path}/data/{name}-{token}"
        frame.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(place)
        rows.append((name, place, counted.get["rows"]))
    version = (latest_version(spark, path) or 0) + 1
    listed = spark.createDataFrame([(version, *row) for row in rows], MANIFEST)
    listed.coalesce(1).write.parquet(f"{path}/manifests/version={version}")
    return version


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """All manifests; none before the first run."""
    return read_log(spark, f"{path}/manifests/*", MANIFEST)


def latest_version(spark: SparkSession, path: str) -> int | None:
    return _manifests(spark, path).agg(F.max("version")).first()[0]


def read_run(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """An output of a published run, the latest by default. A table whose rows are not as many as the manifest says, or
    that no run published, is an error."""
    version = latest_version(spark, path) if version is None else version
    listed = _manifests(spark, path).where((F.col("version") == version) & (F.col("output") == name)).collect()
    if not listed:
        raise ValueError(f"no published output {name} in version {version}")
    found = spark.read.parquet(listed[0]["path"])
    if found.count() != listed[0]["rows"]:
        raise ValueError(f"output {name} of version {version} is not whole")
    return found


def metrics_json(metrics: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Metric columns of each run as one JSON document."""
    values = [c for c in metrics.columns if c not in keys]
    return metrics.select(*keys, F.to_json(F.struct(*values)).alias("metrics"))


def append_log(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Log with its declared columns; a log that nobody wrote yet is empty, not missing. Nothing is written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def upsert(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], keep: str = "stored") -> DataFrame:
    """Merge two keyed tables. ``keep`` names the side that wins a shared key."""
    if keep == "stored":
        return stored.unionByName(fresh.join(stored.select(*keys), list(keys), "left_anti"))
    if keep == "fresh":
        return fresh.unionByName(stored.join(fresh.select(*keys), list(keys), "left_anti"))
    raise ValueError(f"unknown winner: {keep}")


def replace_table(frame: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Dynamic overwrite: partitions present in ``frame`` are replaced at commit, others stay."""
    writer = frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def write_requests(requests: DataFrame, path: str, start: str) -> DataFrame:
    """Store the requests from ``start`` on, the series as a real array column; returns their dates."""
    kept = requests.filter(F.col("date") >= F.lit(start).cast("date"))
    kept.write.mode("overwrite").parquet(path)
    return requests.sparkSession.read.parquet(path).select("date").distinct()


def heat_map(cells: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Pivot with the column values given, which spares the extra pass that would collect them."""
    return cells.groupBy(row).pivot(column, list(columns)).agg(F.first(value))
