"""Scheduled incremental scoring: requests that arrive as files are scored once and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from panelworks.operators.forecast import FORECAST_SCHEMA, Scorer, forecast, missing_requests
from panelworks.sinks.tables import read_log

REQUEST_SCHEMA = "symbol string, date date, series array<double>"


def score_arrivals(
    spark: SparkSession,
    requests_dir: str,
    store_dir: str,
    checkpoint_dir: str,
    scorer: Scorer,
    horizon: int,
    context_len: int,
    kind: str,
) -> StreamingQuery:
    """Process every request file that is new since the last run, then stop.

    The checkpoint remembers the files already read. Keys that the store holds are left out, so a batch
    that is repeated after a failure adds nothing twice.
    """

    def append(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["symbol", "date"])
        session = batch.sparkSession
        bounds = fresh.agg(F.min("date").alias("first"), F.max("date").alias("last"))
        held = read_log(session, store_dir, FORECAST_SCHEMA)
        # Only the arrivals' own dates of the store are read.
        stored = held.join(F.broadcast(bounds), held["date"].between(F.col("first"), F.col("last"))).select(held.columns)
        scored = forecast(missing_requests(fresh, stored), scorer, horizon, context_len, kind)
        scored.write.mode("append").parquet(store_dir)

    arrivals = spark.readStream.schema(REQUEST_SCHEMA).parquet(requests_dir)
    writer = arrivals.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint_dir)
    return writer.trigger(availableNow=True).start()
