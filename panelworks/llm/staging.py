"""Tables that outlive a job: written to the folder the cluster shares, read back without lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space; everything between two of these is a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside an operator: it sorts before every other one.
NO_ID = -(1 << 63)
#: Bytes of rows in one batch for Python.
BATCH_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session without the setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def bound_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python BATCH_BYTES at a time (or one row that is longer), where the session does not say
    otherwise: a batch is held by the executor and by its worker, for each core."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def stored(frame: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``frame`` once and read it back, so that a lost executor costs a re-read and later steps see its size.

    ``options`` are the Parquet writer's.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path, **options)
    return spark.read.schema(frame.schema).parquet(path)


def broadcast_if_small(frame: DataFrame, rows: int = 20_000) -> DataFrame:
    """Hint a broadcast only where a count proves that ``frame`` is small; else the join shuffles."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def with_spans(rows: DataFrame, spans: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rows`` (``id, text``) with the ``spans`` of their id, or null.

    Up to ``most`` ids (8 bytes each, counted) are sent to the scans: only rows with spans are shuffled, the others pass
    straight through. Beyond that all rows are joined.
    """
    spans = spans.withColumnRenamed("id", "_of")
    if spans.limit(most + 1).count() > most:
        return rows.join(spans, F.col("id") == F.col("_of"), "left").select("id", "text", "spans")
    ids = F.broadcast(spans.select(F.col("_of").alias("_has")))
    touched = rows.join(ids, F.col("id") == F.col("_has"), "left_semi").join(spans, F.col("id") == F.col("_of"))
    untouched = rows.join(ids, F.col("id") == F.col("_has"), "left_anti")
    return touched.select("id", "text", "spans").unionByName(
        untouched.select("id", "text", F.lit(None).cast("binary").alias("spans"))
    )


def known_id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_or_null(column: Column) -> Column:
    return F.when(column != F.lit(NO_ID), column)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
