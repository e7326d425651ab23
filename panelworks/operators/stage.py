"""Writing an intermediate table where executors can find it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Without it a local session uses a folder of its warehouse; on
    a cluster that folder is the driver's own unless set, so there the setting is required. The caller's settings stay
    as they are."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stage"


def materialize(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` as a columnar table and read it back: the lineage ends there, later readers prune
    columns, and a lost executor costs only a re-read."""
    spark = frame.sparkSession
    path = f"{stage_dir(spark)}/panelworks/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
