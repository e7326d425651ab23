from datetime import date

import pytest
from helpers import D, business_days, column, frame, one_key, panel, rows
from pyspark.sql import functions as F

from panelworks.functions.windows import Mean, padded_change, rolling, with_rolling_means
from panelworks.operators import calendar as cal
from panelworks.operators.ewm import Ewm, ewm_columns
from panelworks.operators.panel import align, log_returns, resample
from panelworks.sources.bars import normalize_bars


def _sessions(spark, *days):
    return spark.createDataFrame([(D(d),) for d in days], "date date")


def test_weekend_event_shows_at_next_session(spark):
    events = frame(spark, [("AAA", "2024-03-31", 42.0)], "symbol string, date date, v double")
    out = align(events, _sessions(spark, "2024-03-29", "2024-04-01"), events.select("symbol"), ["v"])
    assert column(out, "v", "date") == [None, 42.0]


def test_the_two_fills_differ_on_null_rows(spark):
    data = [("A", "2024-01-01", 1.0), ("A", "2024-01-02", None), ("A", "2024-01-04", 3.0)]
    events = frame(spark, data, "symbol string, date date, v double")
    days = _sessions(spark, "2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05")
    keys = events.select("symbol").distinct()
    assert column(align(events, days, keys, ["v"]), "v", "date") == [1.0, 1.0, 1.0, 3.0]
    assert column(align(events, days, keys, ["v"], carry="row"), "v", "date") == [1.0, None, None, 3.0]


def test_weekly_bins_are_contiguous(spark):
    days = [D("2024-01-02"), D("2024-01-03"), D("2024-01-08"), D("2024-01-19")]
    p = panel(spark, {"A": [1.0, None, None, 4.0]}, days, volume=1.0)
    weekly = resample(p, "weekly").prices
    assert rows(weekly.select("date", "close", "volume"), "date") == [
        (date(2024, 1, 5), 1.0, 1.0),
        (date(2024, 1, 12), None, 0.0),
        (date(2024, 1, 19), 4.0, 1.0),
    ]
    with pytest.raises(ValueError):
        resample(p, "hourly")


def test_dense_panel_has_every_session(spark):
    days = business_days("2024-01-01", 6)
    p = panel(spark, {"A": [None, 2.0, None, None, 5.0, None], "B": [None] * 6}, days)
    got = rows(p.prices.select("symbol", "date", "close"), "symbol", "date")
    assert got == [("A", d, v) for d, v in zip(days, [None, 2.0, None, None, 5.0, None])] + [("B", d, None) for d in days]


def test_ewm_ages_over_gaps(spark):
    x = one_key(spark, [1.0, None, 3.0, None, None, 4.0, 2.0])
    out = ewm_columns(x, [Ewm("y", "x", 0.3, 1), Ewm("late", "x", 0.3, 3)])
    want = [1, 1, 1.759493670886076, 1.759493670886076, 1.759493670886076, 2.804830993956336, 2.563381695769435]
    assert column(out, "y", "date") == pytest.approx(want)
    late = column(out, "late", "date")
    assert late[:5] == [None] * 5 and late[5:] == pytest.approx(want[5:])


def test_padded_change(spark):
    out = one_key(spark, [1.0, None, 2.0]).select("date", padded_change("x").alias("c"))
    assert column(out, "c", "date") == [None, 0.0, 1.0]


@pytest.mark.parametrize("n", [31, 32, 33, 60])
def test_mean_forgets_a_spike(spark, n):
    """What has left the frame leaves no trace, however large, whatever the length of the window."""
    x = one_key(spark, [1.0] * 20 + [1e17] + [1.0] * 200)
    for out in (x.select("date", rolling("x", n).alias("m")), with_rolling_means(x, {"m": Mean("x", n)})):
        means = column(out, "m", "date")
        assert means[-1] == 1.0 and means[max(20, n // 2)] > 1e15 and means[20 + n] == 1.0


def test_rolling_means_of_several_lengths_with_gaps(spark):
    values = [None if i % 7 == 3 or 40 < i < 60 else float(i * i % 101) for i in range(130)]
    x = one_key(spark, values).withColumn("y", -F.col("x"))
    other = x.withColumn("symbol", F.lit("B")).withColumn("x", F.col("x") * 2)
    wanted = {"a": Mean("x", 1), "b": Mean("x", 13, 1), "c": Mean("x", 64), "d": Mean("y", 100, 3)}
    got = with_rolling_means(x.unionByName(other), wanted)
    assert got.columns == [*x.columns, *wanted]
    for out, mean in wanted.items():
        for symbol, scale in (("A", 1.0), ("B", 2.0 if mean.value == "x" else 1.0)):
            need = max(2, mean.n // 2) if mean.need is None else mean.need
            for i, m in enumerate(column(got.where(F.col("symbol") == symbol), out, "date")):
                frame = [v for v in values[max(0, i - mean.n + 1) : i + 1] if v is not None]
                want = scale * sum(frame) / len(frame) * (-1 if mean.value == "y" else 1) if len(frame) >= need else None
                assert m == want or abs(m - want) < 1e-12 * max(1, abs(want))


def test_ingest_turns_nan_and_infinity_into_null(spark):
    raw = spark.createDataFrame(
        [("A", "2024-01-02", v, v, v, v, "5") for v in ("NaN", "Infinity", "-Infinity", "1.5", "x")],
        "symbol string, Date string, Open string, high string, low string, close string, volume string",
    )
    assert sorted(column(normalize_bars(raw.withColumnRenamed("Date", "date")), "close", "close"), key=str) == [1.5, None, None, None, None]



def test_missing_volume_has_no_log_return(spark):
    days = business_days("2024-01-01", 3)
    p = panel(spark, {"A": [1.0, None, 2.0]}, days, volume=10.0)
    assert column(log_returns(p.prices, "volume", "r"), "r", "date") == [None, None, None]


def test_calendar(spark):
    days = spark.createDataFrame([(d,) for d in business_days("2026-04-01", 43)], "date date")
    targets = _sessions(spark, "2026-04-01", "2026-04-13")
    monthly = cal.rebalance_sessions(days, "monthly")
    assert column(cal.is_rebalance(targets, monthly), "is_rebalance", "date") == [True, False]
    assert column(cal.next_rebalance(targets, days, "monthly"), "next_rebalance", "date") == [D("2026-04-01"), D("2026-05-01")]
    asked = _sessions(spark, "2026-04-01", "2026-04-04", "2026-04-13")
    assert column(cal.month_start_guard(asked, days), "go", "date") == [True, False, False]
    with pytest.raises(ValueError):
        cal.rebalance_sessions(days, "yearly")


def test_previous_session_at_the_edges(spark):
    days = _sessions(spark, "2024-01-02", "2024-01-05")
    asked = _sessions(spark, "2024-01-01", "2024-01-02", "2024-01-04", "2024-01-05", "2024-02-01")
    want = [D("2024-01-01"), D("2024-01-02"), D("2024-01-02"), D("2024-01-02"), D("2024-01-05")]
    assert column(cal.previous_session(asked, days), "prior_end", "date") == want
    nxt = column(cal.next_or_same(asked, days), "session", "date")
    assert nxt == [D("2024-01-02"), D("2024-01-02"), D("2024-01-05"), D("2024-01-05"), None]
