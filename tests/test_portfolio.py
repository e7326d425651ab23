import random

import pytest
from helpers import D, business_days, column, panel, rows
from pyspark.sql import functions as F

from panelworks.settings import Selection
from panelworks.operators import portfolio as pf
from panelworks.operators import sizing as sz
from panelworks.operators.panel import trade_prices
from panelworks.operators.scoring import target_holdings
from panelworks.sources import bars

SCHEMA = "run_id string, date date, rank int, symbol string, weight double"


def simulate(prices, days, targets, cost, capital, mode):
    """Session loop over plain dictionaries. ``mode``: weighted, turnover or overlap."""

    def last_close(s, i):
        return next((prices[s][j][1] for j in range(i, -1, -1) if prices[s][j] is not None), None)

    def price(s, i, side):
        bar = prices[s][i]
        return bar[0] if side == "open" and bar is not None else last_close(s, i)

    cash, held, curve = capital, {}, []
    for i, day in enumerate(days):
        want = targets.get(day)
        if want is not None and mode == "weighted" and want and {s for s, _ in want} == set(held):
            want = None
        if want is not None:
            names = [s for s, _ in want]
            leaving = list(held) if mode != "overlap" else [s for s in held if s not in names]
            for s in leaving:
                if price(s, i, "open") is not None:
                    cash += held.pop(s) * price(s, i, "open") * (1 - cost)
            new = [s for s in names if s not in held]
            stake = cash / len(names) if mode == "turnover" and names else (cash / len(new) if new else 0)
            for s, w in want:
                px = price(s, i, "open")
                if s in held or px is None or px <= 0:
                    continue
                spend = cash * w if mode == "weighted" else stake
                if spend <= 0:
                    continue
                held[s] = spend * (1 - cost) / px
                cash -= spend
        curve.append(cash + sum(n * last_close(s, i) for s, n in held.items()))
    return curve


def _market(seed, n_days=60, symbols="ABCDE"):
    rng = random.Random(seed)
    days = business_days("2024-01-01", n_days)
    prices = {}
    for s in symbols:
        level, series = 50.0, []
        for i in range(n_days):
            level *= 1 + rng.uniform(-0.05, 0.05)
            gone = rng.random() < 0.25 or (s == "E" and i < 30)
            series.append(None if gone else (level * (1 + rng.uniform(-0.01, 0.01)), level))
        prices[s] = series
    targets = {}
    for i in range(4, n_days, rng.choice([3, 5, 7])):
        names = rng.sample(symbols, rng.choice([0, 1, 2, 2, 3]))
        targets[days[i]] = [(s, rng.choice([0.5, 1 / 3, 0.7])) for s in names]
        if targets[days[i]] and rng.random() < 0.4:
            targets[days[min(i + 1, n_days - 1)]] = list(targets[days[i]])
    return days, prices, targets


def _frames(spark, markets):
    """Several random markets as runs over disjoint symbols."""
    days = markets[0][0]
    closes, opens, out = {}, {}, []
    for k, (_, prices, targets) in enumerate(markets):
        for s, series in prices.items():
            closes[f"{k}{s}"] = [None if b is None else b[1] for b in series]
            opens[f"{k}{s}"] = [None if b is None else b[0] for b in series]
        for day, want in targets.items():
            out += [(f"r{k}", day, j + 1, f"{k}{s}", w) for j, (s, w) in enumerate(want)] or [(f"r{k}", day, None, None, None)]
    p = panel(spark, closes, days, opens=opens)
    return p, spark.createDataFrame(out, SCHEMA)


@pytest.mark.parametrize("mode", ["weighted", "turnover", "overlap"])
def test_valuation_equals_a_session_loop(spark, mode):
    markets = [_market(seed) for seed in range(12)]
    if mode == "weighted":
        for _, _, targets in markets:
            for day, want in targets.items():
                total = sum(w for _, w in want)
                targets[day] = [(s, w / total) for s, w in want] if total > 1 + 1e-9 else want
    p, targets = _frames(spark, markets)
    px = trade_prices(p.prices)
    if mode == "overlap":
        v = pf.keep_overlap(targets, px, 0.002, 1000.0)
    elif mode == "turnover":
        v = pf.value(pf.equal_targets(targets), px, 0.002, 1000.0, skip_unchanged=False, sequential=False)
    else:
        v = pf.value(targets, px, 0.002, 1000.0)
    got = {(r["run_id"], r["date"]): r["equity"] for r in pf.equity_curve(v, px, p.sessions, 1000.0).collect()}
    for k, (days, prices, wanted) in enumerate(markets):
        want = simulate(prices, days, wanted, 0.002, 1000.0, mode)
        assert [got[f"r{k}", d] for d in days] == pytest.approx(want), (mode, k)


def test_sequential_cash_weights(spark):
    days = business_days("2024-01-01", 3)
    p = panel(spark, {s: [10.0, 10.0, 10.0] for s in "ABC"}, days)
    t = spark.createDataFrame([("r", days[0], i + 1, s, w) for i, (s, w) in enumerate(zip("ABC", (0.5, 0.3, 0.2)))], SCHEMA)
    v = pf.value(t, trade_prices(p.prices), 0.0, 1.0)
    assert column(v.positions, "cost_basis", "rank") == pytest.approx([0.5, 0.15, 0.07])
    assert v.periods.first()["cash"] == pytest.approx(0.28)


def test_positions_are_summed(spark):
    raw = spark.createDataFrame([("AAPL", "10"), ("aapl", "5"), ("MSFT", "0"), ("", "7")], "symbol string, shares string")
    assert rows(bars.positions(raw)) == [("AAPL", 15.0)]


def _plan(spark, due=True, full=False):
    screen = spark.createDataFrame([("AAA", 1, 1.2, "Alpha"), ("BBB", 2, 0.9, "Beta")], "symbol string, rank int, composite_score double, name string")
    held = spark.createDataFrame([("AAA", 10.0), ("CCC", 4.0)], "symbol string, shares double")
    names = spark.createDataFrame([("CCC", "Gamma")], "symbol string, name string")
    plan = pf.rebalance_plan(screen, held, due, full, names)
    return rows(plan.select("action", "symbol", "name", "target_weight", "target_rank"), "priority", "symbol")


def test_rebalance_plan(spark):
    assert _plan(spark) == [("SELL", "CCC", "Gamma", 0.0, None), ("HOLD", "AAA", "Alpha", 0.5, 1), ("BUY", "BBB", "Beta", 0.5, 2)]
    assert [r[:2] for r in _plan(spark, due=False)] == [("HOLD", "AAA"), ("HOLD", "CCC")]
    assert [r[:2] for r in _plan(spark, full=True)] == [("SELL", "AAA"), ("SELL", "CCC"), ("BUY", "AAA"), ("BUY", "BBB")]


def test_missing_volatility_dominates(spark):
    day = D("2024-01-02")
    picks = spark.createDataFrame([(day, 1, "A", 1.0), (day, 2, "B", 0.5)], "date date, rank int, symbol string, score double")
    vols = spark.createDataFrame([("A", day, 0.01), ("B", day, None)], "symbol string, date date, vol double")
    got = dict(rows(sz.inverse_vol_weights(picks, vols).select("symbol", "weight")))
    assert got == pytest.approx({"A": 100 / 1100, "B": 1000 / 1100})


def test_noise_does_not_depend_on_partitioning(spark):
    s = spark.range(200).select(F.lit(D("2024-01-02")).alias("date"), F.col("id").cast("string").alias("symbol"), (F.col("id") / 100 + 1).alias("score"))
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    one = rows(sz.perturb(s, runs, 0.1), "run_id", "symbol")
    other = rows(sz.perturb(s.repartition(7), runs, 0.1), "run_id", "symbol")
    assert [r[:3] for r in one] == [r[:3] for r in other]
    assert [r[3] for r in one] == pytest.approx([r[3] for r in other])
    assert one[0][3] != one[200][3]


def test_target_count_follows_macro(spark):
    s = Selection(names=5)
    f = spark.createDataFrame([(1, None), (2, 0.0), (3, -0.5), (4, -1.0)], "i int, m double")
    assert column(f.select("i", target_holdings("m", s).alias("n")), "n", "i") == [5, 5, 2, 0]
    cashless = Selection(names=1, none_at=None)
    assert column(f.select("i", target_holdings("m", cashless).alias("n")), "n", "i") == [1, 1, 1, 1]
