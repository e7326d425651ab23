import hashlib

import pytest
from helpers import D, business_days, one_key, panel, rows
from pyspark.sql import functions as F

from panelworks.operators import forecast as fc
from panelworks.operators import sweeps as sw
from panelworks.operators import veto as vt
from panelworks.sinks import tables as sink
from panelworks.sources import forecasts as store
from panelworks.streaming.incremental import score_arrivals


def _requests(spark, n, shift=0.0):
    day = D("2024-01-02")
    data = [(f"S{i}", day, [float(i) + shift] * 40) for i in range(n)]
    return spark.createDataFrame(data, "symbol string, date date, series array<double>")


def test_context_is_padded_to_a_patch(spark):
    one = spark.createDataFrame([([1.0, float("nan"), 2.0],), ([],)], "series array<double>")
    zero = [r[0] for r in one.select(fc.prepared_context("series", 20, "volume")).collect()]
    assert zero[0] == [0.0] * 30 + [1.0, 2.0] and zero[1] == [0.0] * 32
    price = [r[0] for r in one.select(fc.prepared_context("series", 20, "price")).collect()]
    assert price[0] == [1.0] * 31 + [2.0]
    assert fc.patch_align(33) == 64 and fc.patch_align(1) == 32


def test_stored_forecasts_are_kept(spark):
    scorer = fc.trailing_mean_scorer(5)
    old = fc.forecast(_requests(spark, 2), scorer, 3, 32, "volume")
    both = fc.forecast_panel(_requests(spark, 4, shift=10.0), old, scorer, 3, 32, "volume")
    assert [(s, m[0]) for s, m in rows(both.select("symbol", "mean"), "symbol")] == [("S0", 0.0), ("S1", 1.0), ("S2", 12.0), ("S3", 13.0)]


def test_quantiles_are_addressed_by_position(spark):
    out = fc.forecast(_requests(spark, 1, 7.0), fc.empirical_quantile_scorer([0.1, 0.9], 8), 4, 32, "volume")
    assert out.select(fc.quantile_mean(1, 4), fc.mean_sum(2)).first()[:] == (7.0, 14.0)


def test_forecast_store_replaces_one_partition(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = _requests(spark, 2).select("symbol", "date", F.col("series").alias("mean"))
    store.store(frame, path, 256, 21, "volume", False)
    store.store(frame.limit(1), path, 256, 21, "price", False)
    store.store(frame.limit(1), path, 256, 21, "volume", False)
    assert store.load(spark, path, 256, 21, "volume", False).count() == 1
    assert store.load(spark, path, 256, 21, "price", False).count() == 1
    assert store.load(spark, path, 64, 5, "volume", False).count() == 0


def test_incremental_scoring_adds_each_key_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    args = (spark, src, out, mark, fc.trailing_mean_scorer(5), 3, 32, "volume")
    _requests(spark, 2).write.parquet(src)
    score_arrivals(*args).awaitTermination(120)
    _requests(spark, 3, 5.0).write.mode("append").parquet(src)
    score_arrivals(*args).awaitTermination(120)
    got = rows(spark.read.parquet(out).select("symbol", "mean"), "symbol")
    assert [(s, m[0]) for s, m in got] == [("S0", 0.0), ("S1", 1.0), ("S2", 7.0)]


def test_upsert_winners(spark):
    a = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    b = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert rows(sink.upsert(a, b, ["k"], "stored"), "k") == [(1, "old"), (2, "old"), (3, "new")]
    assert rows(sink.upsert(a, b, ["k"], "fresh"), "k") == [(1, "old"), (2, "new"), (3, "new")]


def test_log_that_was_never_written_is_empty(spark, tmp_path):
    path = str(tmp_path / "log")
    assert sink.read_log(spark, path, "a int, b string").count() == 0
    sink.append_log(spark.createDataFrame([(1, "x")], "a int, b string"), path)
    assert rows(sink.read_log(spark, path, "a int, b string")) == [(1, "x")]


def test_first_failing_rule_is_the_reason(spark):
    f = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.9, 0.1), (3, 0.9, None)], "i int, a double, b double")
    out = vt.sequential_vetoes(f, [("first", "a", 0.5), ("second", "b", 0.5)])
    assert [r[-1] for r in rows(out, "i")] == ["first", "second", None]


def test_screen_takes_what_the_vetoes_left_of_its_session(spark):
    data = [("2024-01-01", "A", 1.0, 9.0), ("2024-01-02", "A", 1.0, 0.1), ("2024-01-02", "B", 2.0, None), ("2024-01-02", "C", 3.0, 0.4)]
    f = spark.createDataFrame([(D(d), *r) for d, *r in data], "date date, symbol string, score double, a double")
    judged = vt.sequential_vetoes(f, [("low", "a", 0.3)])
    last = judged.agg(F.max("date").alias("date"))
    assert rows(vt.spared(judged, last).select("symbol", "score"), "symbol") == [("B", 2.0), ("C", 3.0)]
    # All names of the session dropped: nothing is left, the session before does not stand in.
    strict = vt.sequential_vetoes(f.filter("a is not null"), [("low", "a", 0.5)])
    assert rows(vt.spared(strict, last)) == []


def test_missing_forecast_is_not_vetoed(spark):
    days = business_days("2024-01-01", 10)
    p = panel(spark, {"A": [1.0] * 10, "B": [1.0] * 10}, days, volume=100.0)
    dates = spark.createDataFrame([(days[9], days[8])], "date date, prior_end date")
    levels = spark.createDataFrame([("A", days[5], 10.0)], "symbol string, date date, level double")
    ratios = vt.volume_ratios(levels, p.prices, dates, 5)
    assert rows(vt.absolute_veto(ratios, 0.5).select("symbol", "ratio", "vetoed"), "symbol") == [("A", 0.1, True), ("B", None, False)]


def test_training_windows_use_own_dates(spark):
    x = one_key(spark, [1.0, 2.0, None, 3.0, 4.0, 5.0, 6.0])
    got = rows(fc.training_windows(x, "x", 2, 2).select("date", "window", "label"), "date")
    assert got[0] == (D("2024-01-04"), [1.0, 2.0], 7.0) and len(got) == 3


def test_leaderboard_skips_deep_drawdowns(spark):
    log = spark.createDataFrame([(1, 1.0, -0.1), (2, 5.0, -0.9), (3, 2.0, -0.2), (4, 2.0, -0.2)], "i int, score double, max_drawdown double")
    assert [r[-1] for r in rows(sw.leaderboard(log, "i", 0.5), "i")] == ["keep", "discard", "keep", "discard"]


def test_sampled_candidates_are_new(spark):
    ids = spark.range(50).select(F.col("id").alias("candidate_id"))
    space, base = {"a": [1, 2, 3], "b": [5, 6]}, {"a": 1, "b": 5}
    out = sw.sample_candidates(ids, space, base, 2, 7)
    hashes = [r["config_hash"] for r in out.collect()]
    assert len(set(hashes)) == len(hashes) == 5
    seen = out.limit(2).select("config_hash")
    assert sw.sample_candidates(ids.repartition(3), space, base, 2, 7, seen).count() == 3


def test_candidates_are_drawn_in_their_rows(spark):
    space, base = {"a": [1, 2, 3], "b": [5, 6], "c": [0, 7, 8, 9], "d": [4]}, {"a": 1, "b": 5, "c": 0, "d": 4}

    def md5(*parts):
        return hashlib.md5(":".join(map(str, ("11", *parts))).encode()).hexdigest()

    want = {}
    for i in (*range(1, 40), 3, 3):
        k = int(md5(i)[:8], 16) % 2 + 1
        picked = sorted("abc", key=lambda p: md5(i, p))[:k]
        new = {p: min((float(v) for v in space[p] if v != base[p]), key=lambda v: md5(i, p, v)) for p in picked}
        key = tuple(new.get(p, float(base[p])) for p in "abcd")
        want[key] = min(i, want.get(key, i))
    ids = spark.createDataFrame([(i,) for i in (None, *reversed(range(1, 40)), 3, 3)], "candidate_id long").repartition(3)
    out = sw.sample_candidates(ids, space, base, 2, 11)
    assert {tuple(r.params): r.candidate_id for r in out.collect()} == want and out.count() == len(want)
    # One candidate's options never make rows, and sets that thousands of candidates draw meet in no task's sort.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert sw.sample_candidates(ids, {"d": [4]}, {"d": 4}, 2, 11).count() == 0


def test_pinball(spark):
    pairs = spark.createDataFrame([(1.0, 0.0, 0.0)], "y double, q0 double, mean double")
    assert fc.pinball(pairs, [0.9]).first()[:] == pytest.approx((0.9, 1.0))
