"""Technical factor queries. Each compares the factor aligned to sessions, before the open lag."""

from __future__ import annotations

from panelworks.catalog.base import r4, rnd
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.settings import Lookbacks
from panelworks.operators import indicators as ind
from panelworks.operators.ewm import Ewm, ewm_columns
from panelworks.plans.trend_picks import pick_trends
from panelworks.sources import market

P = Lookbacks()


def _mean(value: str, n: int, agg: str = "avg") -> str:
    """SQL of a rolling aggregate with the default minimum of observations."""
    w = f"OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({value}) {w} >= {max(2, n // 2)} THEN {agg}({value}) {w} END"


def _aligned(inner: str, name: str) -> str:
    """SQL of a daily signal carried forward over gaps."""
    return f"""SELECT symbol, date, round(last_value({name} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
    ROWS UNBOUNDED PRECEDING), 4) AS {name} FROM ({inner})"""


def _onto_sessions(inner: str, name: str) -> str:
    """SQL of a coarser signal: last non-null value at or before each session."""
    return f"""SELECT g.symbol, g.date, round(a.{name}, 4) AS {name} FROM (SELECT symbol, date FROM symbols, sessions) g
    ASOF LEFT JOIN (SELECT symbol, date, {name} FROM ({inner}) WHERE {name} IS NOT NULL) a
    ON a.symbol = g.symbol AND a.date <= g.date"""


def _factor(name: str, timeframe: str = "daily", params: Lookbacks = P):
    def run(spark, sf_dir):
        out = ind.technical_factors(market.panel(spark, sf_dir), params, timeframe, [name])
        return r4(out, name)

    return run


@query("ind_01_sma", check_sql(f"SELECT symbol, date, round({_mean('close', 50)}, 4) AS sma FROM panel", "panel"))
def sma(spark, sf_dir):
    return market.panel(spark, sf_dir).prices.transform(ind.sma, 50).select("symbol", "date", rnd("sma", "sma"))


def recursive_mean(table: str, value: str, alpha: float, need: int, out: str, keys: str = "symbol") -> tuple[str, str]:
    """SQL of one exponentially weighted mean as a recursive walk over numbered rows. Returns the
    numbering and the walk; NULL rows keep the mean and age its weight."""
    numbered = f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS rn FROM {table}"
    walk = f"""SELECT {keys}, date, rn, {value} AS y, 0 AS gap, CASE WHEN {value} IS NULL THEN 0 ELSE 1 END AS seen
    FROM {out}_n WHERE rn = 1
    UNION ALL SELECT n.{keys}, n.date, n.rn,
    CASE WHEN n.{value} IS NULL THEN w.y WHEN w.y IS NULL THEN n.{value}
    ELSE (pow(1 - {alpha!r}, w.gap + 1) * w.y + {alpha!r} * n.{value}) / (pow(1 - {alpha!r}, w.gap + 1) + {alpha!r}) END,
    CASE WHEN n.{value} IS NULL THEN w.gap + 1 ELSE 0 END,
    w.seen + CASE WHEN n.{value} IS NULL THEN 0 ELSE 1 END
    FROM {out}_w w JOIN {out}_n n ON n.{keys} = w.{keys} AND n.rn = w.rn + 1"""
    return numbered, walk


def ewm_ctes(table: str, value: str, alpha: float, need: int, out: str) -> None:
    numbered, walk = recursive_mean(table, value, alpha, need, out)
    cte(f"{out}_n", numbered, (table,))
    cte(f"{out}_w", walk, (f"{out}_n",))
    cte(out, f"SELECT symbol, date, CASE WHEN seen >= {need} THEN y END AS y FROM {out}_w", (f"{out}_w",))


def span_ctes(table: str, value: str, span: int, out: str) -> None:
    ewm_ctes(table, value, 2.0 / (span + 1.0), max(2, span // 2), out)


span_ctes("panel", "close", 63, "ema63")
span_ctes("panel", "close", 21, "ema21")
span_ctes("panel", "close", 12, "ema12")
span_ctes("panel", "close", 26, "ema26")


@query("ind_02_ema", check_sql("SELECT symbol, date, round(y, 4) AS ema FROM ema63", "ema63"))
def ema(spark, sf_dir):
    prices = market.panel(spark, sf_dir).prices.select("symbol", "date", "close")
    return r4(ewm_columns(prices, [Ewm.span("ema", "close", 63)], keep=["symbol", "date"]), "ema")


FAST, SLOW = _mean("close", 20), _mean("close", 50)
query(
    "ind_03_sma_crossover",
    check_sql(
        _aligned(
            f"SELECT symbol, date, (f - s) / nullif(s, 0) AS sma_crossover FROM (SELECT symbol, date, {FAST} AS f, {SLOW} AS s FROM panel)",
            "sma_crossover",
        ),
        "panel",
    ),
)(_factor("sma_crossover"))

query(
    "ind_04_ema_crossover",
    check_sql(
        _aligned(
            "SELECT f.symbol, f.date, (f.y - s.y) / nullif(s.y, 0) AS ema_crossover FROM ema21 f JOIN ema63 s USING (symbol, date)",
            "ema_crossover",
        ),
        "ema21",
        "ema63",
    ),
)(_factor("ema_crossover"))

query(
    "ind_05_trend_filter",
    check_sql(
        _aligned(
            f"SELECT symbol, date, (close - s) / nullif(s, 0) AS trend_filter FROM (SELECT symbol, date, close, {_mean('close', 200)} AS s FROM panel)",
            "trend_filter",
        ),
        "panel",
    ),
)(_factor("trend_filter"))

query(
    "ind_05_trend_filter_weekly",
    check_sql(
        _onto_sessions(
            f"SELECT symbol, date, (close - s) / nullif(s, 0) AS trend_filter FROM (SELECT symbol, date, close, {_mean('close', 40)} AS s FROM weekly)",
            "trend_filter",
        ),
        "weekly",
        "symbols",
        "sessions",
    ),
)(_factor("trend_filter", "weekly", Lookbacks(trend=40)))

query(
    "ind_06_breakout",
    check_sql(
        _aligned(
            f"SELECT symbol, date, close / nullif({_mean('high', 26, 'max')}, 0) - 1 AS breakout FROM panel", "breakout"
        ),
        "panel",
    ),
)(_factor("breakout"))

cte(
    "deltas",
    """SELECT symbol, date, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END AS gain,
    CASE WHEN d IS NOT NULL THEN -least(d, 0.0) END AS loss FROM (SELECT symbol, date,
    close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM panel)""",
    ("panel",),
)
ewm_ctes("deltas", "gain", 1.0 / 14, 14, "avg_gain")
ewm_ctes("deltas", "loss", 1.0 / 14, 14, "avg_loss")
query(
    "ind_07_rsi",
    check_sql(
        _aligned(
            """SELECT g.symbol, g.date, (100 - 100 / (1 + g.y / nullif(l.y, 0)) - 50) / 50 AS rsi
            FROM avg_gain g JOIN avg_loss l USING (symbol, date)""",
            "rsi",
        ),
        "avg_gain",
        "avg_loss",
    ),
)(_factor("rsi"))

query(
    "ind_08_cci",
    check_sql(
        _aligned(
            f"""SELECT symbol, date, gap / nullif(0.015 * ({_mean('abs(gap)', 20)}), 0) / 200 AS cci FROM (
            SELECT symbol, date, tp - ({_mean('tp', 20)}) AS gap FROM (
            SELECT symbol, date, (high + low + close) / 3 AS tp FROM panel))""",
            "cci",
        ),
        "panel",
    ),
)(_factor("cci"))

cte("macd_line", "SELECT f.symbol, f.date, f.y - s.y AS v FROM ema12 f JOIN ema26 s USING (symbol, date)", ("ema12", "ema26"))
span_ctes("macd_line", "v", 9, "macd_signal")
query(
    "ind_09_macd",
    check_sql(
        _aligned(
            """SELECT m.symbol, m.date, (m.v - g.y) / nullif(p.close, 0) AS macd FROM macd_line m
            JOIN macd_signal g USING (symbol, date) JOIN panel p USING (symbol, date)""",
            "macd",
        ),
        "macd_line",
        "macd_signal",
        "panel",
    ),
)(_factor("macd"))

cte(
    "obv_level",
    """SELECT symbol, date, sum(step) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM (
    SELECT symbol, date, coalesce(sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY date)), 0) * coalesce(volume, 0) AS step
    FROM panel)""",
    ("panel",),
)
cte("obv_sizes", "SELECT symbol, date, abs(v) + 1 AS v FROM obv_level", ("obv_level",))
span_ctes("obv_level", "v", 20, "obv_mean")
span_ctes("obv_sizes", "v", 20, "obv_size")
query(
    "ind_10_obv",
    check_sql(
        _aligned(
            """SELECT o.symbol, o.date, (o.v - m.y) / nullif(s.y, 0) AS obv FROM obv_level o
            JOIN obv_mean m USING (symbol, date) JOIN obv_size s USING (symbol, date)""",
            "obv",
        ),
        "obv_level",
        "obv_mean",
        "obv_size",
    ),
)(_factor("obv"))

query(
    "ind_11_bollinger",
    check_sql(
        _aligned(
            f"SELECT symbol, date, (close - ({_mean('close', 20)})) / nullif(2.0 * ({_mean('close', 20, 'stddev_samp')}), 0) AS bollinger FROM panel",
            "bollinger",
        ),
        "panel",
    ),
)(_factor("bollinger"))

MOMENTUM = """SELECT symbol, date, lag(close, 1) OVER w / nullif(lag(close, 12) OVER w, 0) - 1 AS ts_momentum FROM monthly
    WINDOW w AS (PARTITION BY symbol ORDER BY date)"""
query("ind_12_ts_momentum", check_sql(_onto_sessions(MOMENTUM, "ts_momentum"), "monthly", "symbols", "sessions"))(
    _factor("ts_momentum")
)

HIGHS = " + ".join(f"(close / nullif({_mean('close', n, 'max')}, 0) - 1)" for n in (13, 26, 52))
query(
    "ind_13_variable_week_high",
    check_sql(
        _onto_sessions(f"SELECT symbol, date, ({HIGHS}) / 3 AS variable_week_high FROM weekly", "variable_week_high"),
        "weekly",
        "symbols",
        "sessions",
    ),
)(_factor("variable_week_high"))

ROSE = ", ".join(
    f"CAST(coalesce({f} > lag({f}) OVER (PARTITION BY symbol ORDER BY date), FALSE) AS DOUBLE) AS {f}" for f in ("close", "high", "low")
)
query(
    "ind_14_price_action",
    check_sql(
        _onto_sessions(
            f"""SELECT symbol, date, ({_mean('close', 8)} + {_mean('high', 8)} + {_mean('low', 8)}) / 3 - 0.5
            AS price_action FROM (SELECT symbol, date, {ROSE} FROM weekly)""",
            "price_action",
        ),
        "weekly",
        "symbols",
        "sessions",
    ),
)(_factor("price_action"))


@query(
    "ind_15_avg_dollar_volume",
    check_sql(
        f"SELECT symbol, date, round({_mean('close * volume', 20)}, 8) AS avg_dollar_volume FROM panel", "panel"
    ),
)
def adv(spark, sf_dir):
    prices = market.panel(spark, sf_dir).prices
    return ind.avg_dollar_volume(prices).select("symbol", "date", rnd("avg_dollar_volume", "avg_dollar_volume", 8))


@query(
    "plan_trend_picks",
    check_sql(
        f"""SELECT date, rank, symbol, round(score, 4) AS score FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS INTEGER) AS rank FROM (
        SELECT symbol, date, (rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0)
            / count(*) OVER (PARTITION BY date) - 0.5 AS score FROM (
        SELECT * FROM (SELECT symbol, date, lag(trend_filter) OVER (PARTITION BY symbol ORDER BY date) AS x FROM (
        {_onto_sessions(f"SELECT symbol, date, (close - s) / nullif(s, 0) AS trend_filter FROM (SELECT symbol, date, close, {_mean('close', 40)} AS s FROM weekly)", "trend_filter").replace("round(a.trend_filter, 4)", "a.trend_filter")}
        )) WHERE x IS NOT NULL AND date IN (SELECT date FROM rebal)))) WHERE rank <= 2""",
        "weekly",
        "symbols",
        "sessions",
        "rebal",
    ),
)
def trend(spark, sf_dir):
    return pick_trends(market.panel(spark, sf_dir))
