"""Headline timings. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Panel-level work runs
with one symbol per supplier (1,000 symbols x 1,785 sessions at sf0.1); every result is computed in full
into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from panelworks.catalog import load_all  # noqa: E402
from panelworks.functions.windows import Mean, with_rolling_means  # noqa: E402
from panelworks.operators.indicators import technical_factors  # noqa: E402
from panelworks.operators.panel import lag_for_open  # noqa: E402
from panelworks.operators.xsection import cross_sectional_rank  # noqa: E402
from panelworks.plans.trend_picks import trend_picks  # noqa: E402
from panelworks.settings import TECHNICAL, Lookbacks  # noqa: E402
from panelworks.sources import market  # noqa: E402

BY = "supplier"


def consume(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def cases(spark: SparkSession, sf: str) -> dict:
    catalog = load_all()
    from panelworks.catalog import sizing, studies

    prices = lambda: market.panel(spark, sf, BY).prices

    def factors_and_ranks() -> DataFrame:
        known = lag_for_open(technical_factors(market.panel(spark, sf, BY), Lookbacks()), TECHNICAL)
        return known.select("symbol", "date", *[cross_sectional_rank(c).alias(c) for c in TECHNICAL])

    def noisy_study() -> DataFrame:
        return studies.study(spark, sf, BY, sizing.runs(spark)).metrics

    return {
        "dense_panel": prices,
        "sma_200": lambda: with_rolling_means(prices().select("symbol", "date", "close"), {"sma": Mean("close", 200)}),
        "all_technical_factors_ranked": factors_and_ranks,
        "cross_sectional_rank": lambda: prices().select("symbol", "date", cross_sectional_rank("close").alias("rank")),
        "trend_picks": lambda: trend_picks(spark, sf, BY),
        "volume_forecasts": lambda: sizing.levels(market.panel(spark, sf, BY)),
        "study_with_8_noisy_runs": noisy_study,
        "fundamental_factors": lambda: catalog["fnd_07_factors_on_sessions"].run(spark, sf),
        "asof_close": lambda: catalog["join_02_asof_close"].run(spark, sf),
        "walk_forward_plan": lambda: catalog["wf_11_walk_forward_plan"].run(spark, sf),
    }


def main() -> int:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelworks-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    consume(market.table(spark, sf, "lineitem").agg(F.count("*")))
    only = sys.argv[1:]
    timings = {}
    for name, build in cases(spark, sf).items():
        if only and name not in only:
            continue
        started = time.perf_counter()
        consume(build())
        timings[name] = round(time.perf_counter() - started, 3)
    total = round(sum(timings.values()), 3)
    line = {"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": timings, "sf": Path(sf).name}
    print(json.dumps(line))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
