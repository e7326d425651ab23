import pytest
from helpers import D, business_days, column, frame, panel, rows
from pyspark.sql import functions as F

from panelworks.settings import TECHNICAL, Eligible, Fitting, Lookbacks, Selection, Setup, flat
from panelworks.operators import fundamentals as fnd
from panelworks.operators import walkforward as wf
from panelworks.operators import xsection as xs
from panelworks.operators.eligibility import base_mask
from panelworks.operators.indicators import technical_factors
from panelworks.sources import holdings, macro, statements as stm


def test_rank_of_three(spark):
    data = [("2024-01-01", s, v) for s, v in zip("ABC", (1.0, 2.0, 3.0))]
    f = frame(spark, data, "date date, symbol string, x double")
    assert column(f.select("symbol", xs.cross_sectional_rank("x").alias("r")), "r", "symbol") == pytest.approx([-1 / 6, 1 / 6, 0.5])


def test_rank_with_ties_and_nulls_both_ways(spark):
    data = [("2024-01-01", s, v) for s, v in zip("ABCDE", (3.0, 1.0, None, 1.0, 5.0))]
    f = frame(spark, data, "date date, symbol string, x double")
    want = [0.75, 0.375, None, 0.375, 1.0]
    assert column(f.select("symbol", xs.pct_rank("x").alias("r")), "r", "symbol") == want
    assert column(xs.wide_pct_rank(f, "x"), "rank", "symbol") == want
    assert column(xs.rank_columns(f, ["x"]), "x", "symbol") == [r if r is None else r - 0.5 for r in want]
    z = column(xs.zscore(f, "x"), "z", "symbol")
    assert z[2] is None and sum(v for v in z if v is not None) == pytest.approx(0)
    cut = xs.below_quantile(f, "x", 0.5)
    assert column(cut, "below", "symbol") == [False, True, False, True, False]


def test_one_date_with_most_rows_ranks_the_same(spark):
    skewed = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, D("2024-01-01")).otherwise(D("2024-01-02")).alias("date"),
        F.col("id").cast("string").alias("symbol"),
        ((F.col("id") * 7919) % 500).cast("double").alias("x"),
    )
    a = rows(skewed.select("symbol", "date", F.round(xs.pct_rank("x"), 9)), "symbol", "date")
    b = rows(xs.wide_pct_rank(skewed, "x").select("symbol", "date", F.round("rank", 9)), "symbol", "date")
    assert a == b


def test_momentum_is_positive_on_an_uptrend(spark):
    days = business_days("2020-01-01", 500)
    p = panel(spark, {"AAA": [10 + 40 * i / 499 for i in range(500)]}, days)
    out = technical_factors(p, Lookbacks(), "daily", ["ts_momentum"])
    assert out.orderBy(F.col("date").desc()).first()["ts_momentum"] > 0
    with pytest.raises(ValueError):
        technical_factors(p, Lookbacks(), "daily", ["no_such_factor"])


def test_eligibility_needs_membership_and_history(spark):
    days = business_days("2024-01-01", 80)
    closes = {"AAA": [20 + 20 * i / 79 for i in range(80)], "BBB": [None] * 65 + [15 + 3 * i / 14 for i in range(15)]}
    p = panel(spark, closes, days)
    members = [("AAA", d) for d in days] + [("BBB", d) for d in days[65:]]
    membership = spark.createDataFrame(members, "symbol string, date date")
    mask = base_mask(p.prices, membership, Eligible(sessions=20))
    got = {(r["symbol"], r["date"]): r["eligible"] for r in mask.collect()}
    assert not got["AAA", days[10]] and got["AAA", days[40]] and not got["BBB", days[79]]
    assert len(got) == 160


def test_membership_intervals_and_fallback(spark):
    days = business_days("2024-01-01", 10)
    sessions = spark.createDataFrame([(d,) for d in days], "date date")
    symbols = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    snaps = spark.createDataFrame([(days[3], "A"), (days[6], "B")], "snapshot_date date, ticker string")
    current = spark.createDataFrame([("C",), ("Z",)], "ticker string")
    got = rows(holdings.membership(sessions, symbols, snaps, current), "date")
    assert [s for s, _ in got] == ["C"] * 3 + ["A"] * 3 + ["B"] * 4
    strict = holdings.membership(sessions, symbols, snaps, current, fallback=False)
    assert strict.count() == 7
    with pytest.raises(ValueError):
        holdings.require_universe(snaps.limit(0), False)


def test_group_weights(spark):
    scores = spark.createDataFrame(
        [(0, "sma_crossover", 0.0), (0, "trend_filter", 0.0), (0, "asset_growth", 0.0), (0, "earnings_yield", 0.0)],
        "split_id int, factor string, ic double",
    )
    out = wf.grouped_weights(scores, False, 0.075, {"asset_growth": 2.0, "earnings_yield": 1.0})
    got = {r["factor"]: r["weight"] for r in out.collect()}
    want = {"sma_crossover": 0.4625, "trend_filter": 0.4625, "asset_growth": 0.05, "earnings_yield": 0.025}
    assert got == pytest.approx(want)


def test_splits_do_not_overlap_their_test_range(spark):
    import pandas as pd

    days = [d.date() for d in pd.date_range("2018-01-02", periods=72, freq="MS")]
    calendar = spark.createDataFrame([(d,) for d in days], "date date")
    splits = wf.build_splits(calendar, Fitting(train_months=24, test_months=6, step_months=6, least_dates=12)).collect()
    assert len(splits) == 8 and [s.split_id for s in splits] == list(range(8))
    for s in splits:
        assert s.train_end < s.test_start and s.n_train >= 12 and s.n_test >= 1
    assert all(a.test_end < b.test_start for a, b in zip(splits, splits[1:]))
    assert wf.build_splits(calendar.limit(0), Fitting()).count() == 0


def test_constant_side_has_no_correlation(spark):
    day = D("2024-01-01")
    ranks = spark.createDataFrame([(s, day, 1.0, float(i)) for i, s in enumerate("ABCD")], "symbol string, date date, flat double, up double")
    forward = spark.createDataFrame([(s, day, float(i)) for i, s in enumerate("ABCD")], "symbol string, date date, forward_return double")
    got = rows(wf.information_coefficients(ranks, forward, ["flat", "up"], 3), "factor")
    assert got == [("up", day, pytest.approx(1.0))]


def test_publication_lag(spark):
    series = spark.createDataFrame([("CFNAI", D(f"2024-0{m}-01"), m / 10) for m in range(1, 6)], "series_id string, date date, value double")
    days = spark.createDataFrame([(d,) for d in business_days("2024-01-02", 60)], "date date")
    meta = macro.series_meta(spark).filter("series_id = 'CFNAI'")
    out = macro.released(series, meta, days)
    got = {r["date"]: r["value"] for r in out.collect()}
    assert got[D("2024-01-15")] is None and got[D("2024-03-18")] == 0.2


def test_macro_read_and_composite(spark, tmp_path):
    days = business_days("2023-12-01", 40)
    lines = ["date,value"] + [f"{d},{10 + 20 * i / 39}" for i, d in enumerate(days)] + ["2024-02-01,."]
    (tmp_path / "VIXCLS.csv").write_text("\n".join(lines))
    series = macro.read_series(spark, str(tmp_path))
    assert series.count() == 41 and series.filter("value is null").count() == 1
    sessions = spark.createDataFrame([(d,) for d in business_days("2024-01-02", 10)], "date date")
    meta = macro.series_meta(spark).filter("series_id = 'VIXCLS'")
    assert macro.composite(macro.standardized(series, meta, sessions, 5)).count() == 10


def test_fundamentals_filed_on_a_weekend(spark):
    p = panel(spark, {"AAA": [10.0, 11.0]}, [D("2024-03-29"), D("2024-04-01")])
    lines = [("AAA", "quarterly", "balance", "Total Assets", D("2024-03-30"), 1000.0)]
    lines.append(("AAA", "quarterly", "balance", "Stockholders Equity", D("2024-03-30"), 500.0))
    rows_ = spark.createDataFrame(lines, "symbol string, freq string, statement string, label string, period_end date, value double")
    info = spark.createDataFrame([("AAA", {"sharesOutstanding": "100"})], "symbol string, info map<string,string>")
    earnings = spark.createDataFrame([], "symbol string, date date, surprise double")
    chosen = stm.choose_labels(rows_, stm.label_table(spark))
    records = fnd.fundamental_records(chosen, rows_.select("symbol", "period_end"), p.prices, info, earnings, 1)
    out = fnd.fundamental_factors(records, p.sessions, p.symbols, ["book_to_market"])
    assert column(out, "book_to_market", "date") == [None, 0.5]


def test_settings_flatten_and_choose():
    paths = flat(Setup(selection=Selection(names=2)))
    assert paths["selection.names"] == 2 and paths["fitting.step_months"] == 6 and "selection" not in paths
    assert Setup(factors=("rsi", "sma_crossover", "other")).chosen(TECHNICAL) == ["sma_crossover", "rsi"]
