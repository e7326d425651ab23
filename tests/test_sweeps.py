"""Settings as a dimension, joined segments of curves, pruned readings, exact samples and published runs."""

import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.catalog.sensitivity import VARIANTS
from panelworks.operators import forecast as fc
from panelworks.operators import metrics as mt
from panelworks.plans import sensitivity as sv
from panelworks.sinks import tables as sink
from panelworks.sources import forecasts as store
from tests.helpers import rows


def test_work_grows_with_distinct_settings_only():
    found = sv.pieces(VARIANTS)
    assert len(VARIANTS) == 27 and len({name.split("=")[0] for name in VARIANTS} - {"base"}) == 13
    # 5 crossovers, 3 trends, 3 momenta; 3 liquidity rules; 15 fits: all but veto, macro, names, cost and liquidity.
    assert [len(x) for x in (found.factors, found.masks, found.weights, found.scores)] == [11, 3, 15, 17]
    again = sv.pieces(VARIANTS | {f"{name} again": v for name, v in VARIANTS.items()})
    assert [len(x) for x in (again.factors, again.masks, again.weights, again.scores)] == [11, 3, 15, 17]


def test_paths_reach_tuples_and_mappings():
    base = VARIANTS["base"]
    assert VARIANTS["sma_fast=8"].setup.lookbacks.averages == (8, base.setup.lookbacks.averages[1])
    assert VARIANTS["asset_growth=4.0"].setup.fitting.given == {**base.setup.fitting.given, "asset_growth": 4.0}
    with pytest.raises(TypeError):
        sv.moved(base, "setup.nothing", 1)


def test_variants_with_another_calendar_are_refused():
    other = sv.moved(VARIANTS["base"], "setup.rebalance", "weekly")
    with pytest.raises(ValueError, match="another calendar"):
        sv.score_versions(None, {"base": VARIANTS["base"], "other": other})


def test_joined_segments_equal_a_replay(spark):
    rng = np.random.default_rng(3)
    days = [date(2019, 11, 1) + timedelta(days=i) for i in range(900)]
    curves = {k: 100 * np.cumprod(1 + rng.normal(0.0005, 0.02, len(days))) for k in (0.0, 1.0)}
    data = [(k, d, float(v)) for k, curve in curves.items() for d, v in zip(days, curve)]
    equity = spark.createDataFrame(data, "alpha double, date date, equity double").withColumn("year", F.year("date")).repartition(5)
    parts = mt.segments(equity, ["alpha", "year"])
    got = {(r.alpha, r.year): r for r in mt.segment_metrics(mt.joined_before(parts, "alpha", "year"), ["alpha", "year"]).collect()}
    assert got[0.0, 2019].sharpe is None
    for alpha, curve in curves.items():
        for year in (2020, 2021, 2022):
            past = curve[[d.year < year for d in days]]
            r = past[1:] / past[:-1] - 1 - 0.05 / 252
            fall = (past / np.maximum.accumulate(past) - 1).min()
            span = (date(year - 1, 12, 31) - days[0]).days
            want = (252**0.5 * r.mean() / r.std(ddof=1), (past[-1] / past[0]) ** (365.25 / span) - 1, fall)
            assert np.allclose((got[alpha, year].sharpe, got[alpha, year].cagr, got[alpha, year].max_drawdown), want, rtol=1e-9)
    chosen = mt.choose_by_prior_sharpe(equity.drop("year"), "alpha").collect()
    assert {r.year: r.alpha for r in chosen} == {
        y: max((0.0, 1.0), key=lambda a: (got[a, y].sharpe, -a)) for y in (2020, 2021, 2022)
    }


def test_readings_open_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    base = spark.createDataFrame([("A", date(2024, 1, 2)), ("B", date(2024, 1, 2))], "symbol string, date date")
    for hor, kind, level in ((21, "volume", 2.0), (5, "volume", 3.0), (21, "price", 4.0)):
        made = base.withColumn("mean", F.array_repeat(F.lit(level), hor))
        store.store(made.where("symbol = 'A'") if kind == "price" else made, path, 60, hor, kind, False)
    wanted = {"long": store.Reading(60, 21, "volume", fc.mean_sum(21)), "short": store.Reading(60, 5, "volume", fc.mean_sum(5))}
    both = store.readings(spark, path, wanted)
    assert rows(both, "symbol") == [("A", date(2024, 1, 2), 42.0, 15.0), ("B", date(2024, 1, 2), 42.0, 15.0)]
    plan = both._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*ctx", plan) and plan.count("FileScan parquet") == 1
    price = store.readings(spark, path, wanted | {"price": store.Reading(60, 21, "price", fc.mean_sum(1))})
    assert [r.price for r in price.orderBy("symbol").collect()] == [4.0, None]


@pytest.mark.parametrize("n", [0, 1, 137, 999, 1000, 5000])
def test_sample_is_exact_and_the_same_over_partitionings(spark, n):
    windows = spark.range(1000).select(F.concat(F.lit("S"), F.col("id") % 7).alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    one, other = (fc.sample_windows(windows.repartition(k), n, 5, edge=edge).collect() for k, edge in ((1, 10), (7, 10_000)))
    assert len(one) == min(n, 1000) and set(one) == set(other)
    assert n in (0, 1000, 5000) or set(one) != set(fc.sample_windows(windows, n, 6).collect())


def test_scorers_are_expressions(spark):
    context = [float(v) for v in np.random.default_rng(1).normal(size=64)]
    frame = spark.createDataFrame([(context,)], "context array<double>")
    mean, _ = fc.trailing_mean_scorer(21).of(F.col("context"), 3)
    drift, _ = fc.drift_scorer().of(F.col("context"), 4)
    level, q = fc.empirical_quantile_scorer([0.1, 0.5, 0.93]).of(F.col("context"), 2)
    got = frame.select(mean, drift, level, q).first()
    assert np.allclose(got[0], [np.mean(context[-21:])] * 3)
    assert np.allclose(got[1], context[-1] + (context[-1] - context[0]) / 63 * np.arange(1, 5))
    assert np.allclose(got[2], [np.mean(context)] * 2) and np.allclose(got[3], [np.quantile(context, [0.1, 0.5, 0.93])] * 2)


def test_a_run_shows_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "run")
    assert sink.latest_version(spark, path) is None
    assert sink.publish_run(path, equity=spark.range(5), trades=spark.range(3)) == 1
    broken = spark.range(4).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        sink.publish_run(path, equity=spark.range(9), trades=broken)
    assert sink.latest_version(spark, path) == 1 and sink.read_run(spark, path, "equity").count() == 5
    assert sink.publish_run(path, equity=spark.range(7)) == 2
    assert sink.read_run(spark, path, "equity").count() == 7 and sink.read_run(spark, path, "trades", 1).count() == 3
    with pytest.raises(ValueError, match="no published output"):
        sink.read_run(spark, path, "trades")
