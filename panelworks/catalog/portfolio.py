"""Valuation and rebalance-plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.catalog import forecasts, sizing, tables  # noqa: F401  (shared table expressions)
from panelworks.catalog.base import r4
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.catalog.sources import staged
from panelworks.operators import metrics as mt
from panelworks.operators import portfolio as pf
from panelworks.operators import sizing as sz
from panelworks.operators import veto as vt
from panelworks.operators.panel import trade_prices
from panelworks.operators.stage import materialize
from panelworks.sinks import tables as sink
from panelworks.sources import market

COST, CAPITAL = 0.001, 100_000.0

cte(
    "px",
    """SELECT symbol, date, coalesce(open, lc) AS open_px, lc AS close_px FROM (SELECT *, last_value(close IGNORE NULLS)
    OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS lc FROM panel)""",
    ("panel",),
)
cte(
    "targets",
    """SELECT 'n3' AS run_id, date, rank, symbol, weight FROM vol_picks UNION ALL SELECT 'n2', date, rank, symbol, 0.5 FROM picks WHERE rank <= 2
    UNION ALL SELECT 'n2', date, NULL, NULL, NULL FROM rebal WHERE date > (SELECT min(date) FROM picks) AND date NOT IN (SELECT date FROM picks)""",
    ("vol_picks", "picks", "rebal"),
)


def valuation_ctes(prefix: str, targets: str, cost: float | str, skip: bool, sequential: bool) -> None:
    """Closed-form valuation of a target table in SQL: <prefix>_positions, _periods and _equity. ``cost`` is a number or
    a column of the targets."""
    carried, cost = ("", cost) if not isinstance(cost, str) else (f"t.{cost}, ", f"b.{cost}")
    p = prefix
    same = "len(want) > 0 AND coalesce(want = prev, FALSE)" if skip else "FALSE"
    left = (
        "coalesce(product(1 - w) OVER (PARTITION BY run_id, date ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)"
        if sequential
        else "1"
    )
    cte(
        f"{p}_priced",
        f"""SELECT t.*, x.open_px AS open FROM {targets} t LEFT JOIN px x ON x.symbol = t.symbol AND x.date = t.date
        WHERE t.symbol IS NULL OR t.weight > 0""",
        (targets, "px"),
    )
    cte(
        f"{p}_kept",
        f"""SELECT run_id, date, total, lead(date) OVER (PARTITION BY run_id ORDER BY date) AS until FROM (SELECT *, lag(got) OVER
        (PARTITION BY run_id ORDER BY date) AS prev FROM (SELECT run_id, date, sum(weight) AS total,
        coalesce(list_sort(list(symbol) FILTER (symbol IS NOT NULL)), []) AS want,
        coalesce(list_sort(list(symbol) FILTER (open > 0)), []) AS got FROM {p}_priced GROUP BY 1, 2)) WHERE NOT ({same})""",
        (f"{p}_priced",),
    )
    cte(
        f"{p}_buys",
        f"""SELECT b.*, x.open_px AS open_next FROM (SELECT *, w * {left} AS eff FROM (SELECT t.run_id, t.date, t.rank, t.symbol, t.open, k.until, {carried}
        t.weight / CASE WHEN k.total > 1 + 1e-9 THEN k.total ELSE 1 END AS w FROM {p}_priced t JOIN {p}_kept k USING (run_id, date)
        WHERE t.open > 0)) b LEFT JOIN px x ON x.symbol = b.symbol AND x.date = b.until""",
        (f"{p}_priced", f"{p}_kept", "px"),
    )
    cte(
        f"{p}_periods",
        f"""SELECT *, {CAPITAL} * coalesce(product(rest + grown) OVER (PARTITION BY run_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 1) AS capital FROM (SELECT k.run_id, k.date, k.until, 1 - coalesce(sum(b.eff), 0) AS rest,
        coalesce(sum(b.eff * (1 - {cost}) * (1 - {cost}) * b.open_next / b.open), 0) AS grown FROM {p}_kept k
        LEFT JOIN {p}_buys b ON b.run_id = k.run_id AND b.date = k.date GROUP BY 1, 2, 3)""",
        (f"{p}_kept", f"{p}_buys"),
    )
    cte(
        f"{p}_positions",
        f"""SELECT b.*, q.capital * b.eff AS cost_basis, q.capital * b.eff * (1 - {cost}) / b.open AS shares FROM {p}_buys b
        JOIN {p}_periods q ON q.run_id = b.run_id AND q.date = b.date""",
        (f"{p}_buys", f"{p}_periods"),
    )
    cte(
        f"{p}_equity",
        f"""SELECT run_id, date, sum(v) AS equity FROM (
        SELECT q.run_id, s.date, q.capital * q.rest AS v FROM {p}_periods q JOIN sessions s ON s.date >= q.date AND (q.until IS NULL OR s.date < q.until)
        UNION ALL SELECT q.run_id, s.date, {CAPITAL} FROM (SELECT run_id, min(date) AS first FROM {p}_periods GROUP BY 1) q JOIN sessions s ON s.date < q.first
        UNION ALL SELECT b.run_id, x.date, b.shares * x.close_px FROM {p}_positions b JOIN px x ON x.symbol = b.symbol AND x.date >= b.date
        AND (b.until IS NULL OR x.date < b.until)) GROUP BY 1, 2""",
        (f"{p}_periods", f"{p}_positions", "sessions", "px"),
    )


cte("equal_targets", "SELECT run_id, date, rank, symbol, CASE WHEN symbol IS NOT NULL THEN 1.0 / count(symbol) OVER (PARTITION BY run_id, date) END AS weight FROM targets", ("targets",))
valuation_ctes("wt", "targets", COST, True, True)
valuation_ctes("ft", "equal_targets", 0.0005, False, False)


def base_targets(spark, sf_dir, p):
    """Runs n3 (inverse volatility, holds when nothing scores) and n2 (halves, goes to cash then)."""
    s = tables.stored_scores(spark, sf_dir, p)
    three = sz.inverse_vol_weights(sz.top_n_equal_weights(s, 3), sz.prior_volatility(p.prices, tables.prior_ends(p), 21))
    two = sz.top_n_equal_weights(s, 2).withColumn("weight", F.lit(0.5))
    cols = ["date", "rank", "symbol", "weight"]
    first = s.agg(F.min("date").alias("_first"))
    empty = tables.monthly(p).crossJoin(F.broadcast(first)).filter("date > _first").select("date")
    empty = empty.join(s.select("date").distinct(), "date", "left_anti")
    two = two.select(*cols).unionByName(empty, allowMissingColumns=True)
    return three.select(F.lit("n3").alias("run_id"), *cols).unionByName(two.select(F.lit("n2").alias("run_id"), *cols))


def weighted(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    px = trade_prices(p.prices)
    return p, px, pf.value(base_targets(spark, sf_dir, p), px, COST, CAPITAL)


def weighted_equity(spark, sf_dir):
    p, px, v = weighted(spark, sf_dir)
    return p, pf.equity_curve(v, px, p.sessions, CAPITAL)


@query(
    "pf_01_trade_prices",
    check_sql("SELECT symbol, date, open_px, close_px FROM px", "px"),
)
def prices(spark, sf_dir):
    return trade_prices(market.panel(spark, sf_dir).prices)


def _logged(equity):
    """Unit prices of the driver tables jump by factors, so curves are compared on a log scale."""
    return equity.select("run_id", "date", F.round(F.ln("equity"), 8).alias("log_equity"))


@query("pf_02_weighted_equity", check_sql("SELECT run_id, date, round(ln(equity), 8) AS log_equity FROM wt_equity", "wt_equity"))
def equity(spark, sf_dir):
    return _logged(weighted_equity(spark, sf_dir)[1])


@query("pf_03_full_turnover_equity", check_sql("SELECT run_id, date, round(ln(equity), 8) AS log_equity FROM ft_equity", "ft_equity"))
def full_turnover(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    px = trade_prices(p.prices)
    v = pf.value(pf.equal_targets(base_targets(spark, sf_dir, p)), px, 0.0005, CAPITAL, skip_unchanged=False, sequential=False)
    return _logged(pf.equity_curve(v, px, p.sessions, CAPITAL))


@query("pf_04_keep_overlap_equity")
def keep_overlap(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    px = trade_prices(p.prices)
    v = pf.keep_overlap(base_targets(spark, sf_dir, p), px, 0.0005, CAPITAL)
    return _logged(pf.equity_curve(v, px, p.sessions, CAPITAL))


cte(
    "wt_trades",
    f"""SELECT run_id, date, 'BUY' AS action, symbol, shares, open AS price, cost_basis * {COST} AS fee, NULL::DOUBLE AS pnl, 'rebalance' AS reason
    FROM wt_positions UNION ALL SELECT b.run_id, coalesce(until, f.date), 'SELL', b.symbol, shares, coalesce(open_next, f.close_px),
    shares * coalesce(open_next, f.close_px) * {COST}, shares * coalesce(open_next, f.close_px) * (1 - {COST}) - cost_basis,
    CASE WHEN until IS NULL THEN 'final' ELSE 'rebalance' END FROM wt_positions b JOIN px f ON f.symbol = b.symbol AND f.date = (SELECT max(date) FROM sessions)""",
    ("wt_positions", "px", "sessions"),
)


@query(
    "pf_05_trade_log",
    check_sql(
        """SELECT run_id, date, action, symbol, round(ln(shares), 6) AS log_shares, price, round(ln(fee), 6) AS log_fee,
        round(pnl / (shares * price), 6) AS pnl_share, reason FROM wt_trades""",
        "wt_trades",
    ),
)
def trade_log(spark, sf_dir):
    p, px, v = weighted(spark, sf_dir)
    fills = pf.trades(v, px, p.sessions, COST)
    return fills.select(
        "run_id",
        "date",
        "action",
        "symbol",
        F.round(F.ln("shares"), 6).alias("log_shares"),
        "price",
        F.round(F.ln("fee"), 6).alias("log_fee"),
        F.round(F.col("pnl") / (F.col("shares") * F.col("price")), 6).alias("pnl_share"),
        "reason",
    )


@query(
    "pf_05_selection_log",
    check_sql(
        """SELECT run_id, date, coalesce(string_agg(symbol, ',' ORDER BY rank), '') AS symbols, count(symbol) AS num_symbols FROM targets GROUP BY 1, 2""",
        "targets",
    ),
)
def selection_log(spark, sf_dir):
    return pf.selection_log(base_targets(spark, sf_dir, market.stored_panel(spark, sf_dir)))


# Plans: the screen is each date's three best names, the positions are the previous date's.
cte(
    "plan_screen",
    """SELECT symbol, rank, score AS composite_score FROM picks WHERE date = (SELECT max(date) FROM picks)""",
    ("picks",),
)
cte(
    "plan_positions",
    """SELECT symbol, 10.0 * rank AS shares FROM picks WHERE date = (SELECT max(date) FROM picks WHERE date < (SELECT max(date) FROM picks))
    UNION SELECT symbol, 7.0 FROM picks WHERE date = (SELECT max(date) FROM picks) AND rank = 1 AND symbol NOT IN (
    SELECT symbol FROM picks WHERE date = (SELECT max(date) FROM picks WHERE date < (SELECT max(date) FROM picks)))""",
    ("picks",),
)
cte(
    "plans",
    """SELECT 'overlap' AS mode, CASE action WHEN 'SELL' THEN 1 WHEN 'HOLD' THEN 2 ELSE 3 END AS priority, action, symbol, shares,
    CASE WHEN action = 'SELL' THEN 0 ELSE 1.0 / (SELECT count(*) FROM plan_screen) END AS target_weight, rank AS target_rank, composite_score
    FROM (SELECT coalesce(s.symbol, p.symbol) AS symbol, p.shares, s.rank, s.composite_score, CASE WHEN s.symbol IS NULL THEN 'SELL'
    WHEN p.symbol IS NULL THEN 'BUY' ELSE 'HOLD' END AS action FROM plan_screen s FULL JOIN plan_positions p ON p.symbol = s.symbol)
    UNION ALL SELECT 'turnover', 1, 'SELL', p.symbol, p.shares, 0, NULL, s.composite_score FROM plan_positions p LEFT JOIN plan_screen s USING (symbol)
    UNION ALL SELECT 'turnover', 3, 'BUY', symbol, NULL, 1.0 / (SELECT count(*) FROM plan_screen), rank, composite_score FROM plan_screen
    UNION ALL SELECT 'not_due', 0, 'HOLD', p.symbol, p.shares, NULL, s.rank, s.composite_score FROM plan_positions p LEFT JOIN plan_screen s USING (symbol)""",
    ("plan_screen", "plan_positions"),
)


def _plan_inputs(spark, sf_dir):
    s = tables.stored_scores(spark, sf_dir, market.stored_panel(spark, sf_dir))
    best = sz.top_n_equal_weights(s, 3)
    last = s.agg(F.max("date").alias("date"))
    before = s.join(F.broadcast(last), "date", "left_anti").agg(F.max("date").alias("date"))
    screen = best.join(F.broadcast(last), "date", "left_semi").select("symbol", "rank", F.col("score").alias("composite_score"))
    old = best.join(F.broadcast(before), "date", "left_semi").select("symbol", (10.0 * F.col("rank")).alias("shares"))
    extra = screen.filter("rank = 1").join(old, "symbol", "left_anti").select("symbol", F.lit(7.0).alias("shares"))
    return screen, old.unionByName(extra), best.join(F.broadcast(last), "date", "left_semi")


def _plans(spark, sf_dir):
    screen, positions, _ = _plan_inputs(spark, sf_dir)
    modes = {"overlap": (True, False), "turnover": (True, True), "not_due": (False, False)}
    parts = [
        pf.rebalance_plan(screen, positions, due, full).withColumn("mode", F.lit(mode)) for mode, (due, full) in modes.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "pf_06_rebalance_plan",
    check_sql(
        """SELECT mode, priority, action, symbol, CAST(shares AS DOUBLE) AS shares, round(target_weight, 6) AS target_weight, CAST(target_rank AS DOUBLE) AS target_rank,
        round(composite_score, 6) AS composite_score FROM plans""",
        "plans",
    ),
)
def plan(spark, sf_dir):
    out = _plans(spark, sf_dir).drop("name", "note").withColumn("target_rank", F.col("target_rank").cast("double"))
    return r4(out, "target_weight", "composite_score", digits=6)


@query(
    "pf_07_order_counts",
    check_sql(
        """SELECT mode, count(*) FILTER (action = 'SELL') AS sell_orders, count(*) FILTER (action = 'BUY') AS buy_orders,
        count(*) FILTER (action = 'HOLD') AS hold_positions FROM plans GROUP BY mode""",
        "plans",
    ),
)
def order_counts(spark, sf_dir):
    return _plans(spark, sf_dir).groupBy("mode").agg(*pf.action_columns())


@query(
    "pf_08_sized_screen",
    check_sql(
        """SELECT CAST(row_number() OVER (ORDER BY v.weight DESC, v.rank) AS INTEGER) AS rank, v.symbol, round(v.weight, 6) AS weight,
        round(v.score, 6) AS composite_score, h.name, h.sector, CASE WHEN p.symbol IS NULL THEN 'BUY' ELSE 'HOLD' END AS action FROM vol_picks v
        LEFT JOIN current_holdings h ON h.ticker = v.symbol LEFT JOIN plan_positions p ON p.symbol = v.symbol WHERE v.date = (SELECT max(date) FROM picks)""",
        "vol_picks",
        "current_holdings",
        "plan_positions",
    ),
)
def sized_screen(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    _, positions, best = _plan_inputs(spark, sf_dir)
    return _sized(spark, sf_dir, p, best, positions)


def _sized(spark, sf_dir, p, best, positions):
    """The screen of the names in ``best``, weighted by inverse volatility."""
    sized = sz.inverse_vol_weights(best, sz.prior_volatility(p.prices, tables.prior_ends(p), 21))
    held = tables.current_holdings(tables.snapshots(spark, sf_dir))
    scores = best.select("date", "symbol", "score")
    out = pf.sized_screen(sized.select("date", "rank", "symbol", "weight"), scores, positions, held)
    return r4(out.drop("date"), "weight", "composite_score", digits=6)


# The screen after the vetoes: the three best names of the last scored date that no forecast rule drops.
cte(
    "spared",
    """SELECT date, symbol, score, rank FROM (SELECT date, symbol, score, row_number() OVER (ORDER BY score DESC, symbol) AS rank
    FROM judged WHERE reason IS NULL AND date = (SELECT max(date) FROM judged)) WHERE rank <= 3""",
    ("judged",),
)
cte(
    "spared_weights",
    """SELECT symbol, rank, score, CASE WHEN count(*) OVER () > 1 THEN inv / sum(inv) OVER () ELSE 1 END AS weight FROM (
    SELECT s.*, CASE WHEN v.vol IS NULL THEN 1000 ELSE 1 / greatest(v.vol, 0.001) END AS inv FROM spared s
    LEFT JOIN prior_vol v ON v.symbol = s.symbol AND v.date = s.date)""",
    ("spared", "prior_vol"),
)


@query(
    "pf_08_vetoed_screen",
    check_sql(
        """SELECT CAST(row_number() OVER (ORDER BY v.weight DESC, v.rank) AS INTEGER) AS rank, v.symbol, round(v.weight, 6) AS weight,
        round(v.score, 6) AS composite_score, h.name, h.sector, CASE WHEN p.symbol IS NULL THEN 'BUY' ELSE 'HOLD' END AS action
        FROM spared_weights v LEFT JOIN current_holdings h ON h.ticker = v.symbol LEFT JOIN plan_positions p ON p.symbol = v.symbol""",
        "spared_weights",
        "current_holdings",
        "plan_positions",
    ),
)
def vetoed_screen(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    _, positions, _ = _plan_inputs(spark, sf_dir)
    judged = materialize(sizing.judged_scores(spark, sf_dir, p, sizing.RULES), "judged")
    spared = vt.spared(judged, judged.agg(F.max("date").alias("date")))
    return _sized(spark, sf_dir, p, sz.top_n_equal_weights(spared.select("date", "symbol", "score"), 3), positions)


def published(spark, sf_dir):
    """A run's equity, trades, selections and summary as JSON, published together; returns where."""
    p = market.stored_panel(spark, sf_dir)
    px = materialize(trade_prices(p.prices), "px")
    targets = materialize(base_targets(spark, sf_dir, p), "targets")
    v = pf.value(targets, px, COST, CAPITAL)
    equity = materialize(pf.equity_curve(v, px, p.sessions, CAPITAL), "equity")
    trades = materialize(pf.trades(v, px, p.sessions, COST), "trades")
    summary = mt.summarize(equity, trades).select("run_id", "num_closed_trades", F.round("max_drawdown", 6).alias("max_drawdown"))
    path = staged(spark, "published")
    sink.publish_run(path, equity=equity, trades=trades, selections=pf.selection_log(targets), metrics=sink.metrics_json(summary))
    return path


cte(
    "wt_summary",
    """SELECT e.run_id, round(min(e.fall), 6) AS max_drawdown, any_value(t.n) AS num_closed_trades FROM (SELECT run_id, equity / max(equity) OVER
    (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM wt_equity) e
    JOIN (SELECT run_id, count(*) AS n FROM wt_trades WHERE action = 'SELL' GROUP BY 1) t USING (run_id) GROUP BY 1""",
    ("wt_equity", "wt_trades"),
)


@query(
    "snk_01_run_outputs",
    check_sql(
        """SELECT e.run_id, e.sessions, e.log_peak, t.trades, s.decisions, s.names, m.max_drawdown, m.num_closed_trades FROM (SELECT run_id, count(*) AS sessions,
        round(ln(max(equity)), 6) AS log_peak FROM wt_equity GROUP BY 1) e JOIN (SELECT run_id, count(*) AS trades FROM wt_trades GROUP BY 1) t USING (run_id)
        JOIN (SELECT run_id, count(DISTINCT date) AS decisions, count(symbol) AS names FROM targets GROUP BY 1) s USING (run_id)
        JOIN wt_summary m USING (run_id)""",
        "wt_equity",
        "wt_trades",
        "targets",
        "wt_summary",
    ),
)
def run_outputs(spark, sf_dir):
    path = published(spark, sf_dir)
    equity, trades, selections, metrics = (sink.read_run(spark, path, name) for name in ("equity", "trades", "selections", "metrics"))
    curve = equity.groupBy("run_id").agg(F.count("*").alias("sessions"), F.round(F.ln(F.max("equity")), 6).alias("log_peak"))
    decided = selections.groupBy("run_id").agg(F.count("*").alias("decisions"), F.sum("num_symbols").alias("names"))
    read = F.from_json("metrics", "num_closed_trades long, max_drawdown double").alias("read")
    return (
        curve.join(trades.groupBy("run_id").agg(F.count("*").alias("trades")), "run_id")
        .join(decided, "run_id")
        .join(metrics.select("run_id", read).select("run_id", "read.max_drawdown", "read.num_closed_trades"), "run_id")
    )


LOG_SCHEMA = "mode string, priority int, action string, symbol string, target_weight double"


@query(
    "snk_02_append_log",
    check_sql(
        "SELECT mode, action, count(*) AS n FROM plans WHERE action IN ('SELL', 'BUY') GROUP BY 1, 2", "plans"
    ),
)
def append_log(spark, sf_dir):
    path = staged(spark, "trade-log")
    rows = pf.orders(_plans(spark, sf_dir)).select("mode", "priority", "action", "symbol", "target_weight")
    sink.read_log(spark, path, LOG_SCHEMA)
    for mode in ("overlap", "turnover"):
        sink.append_log(rows.filter(F.col("mode") == mode), path)
    log = sink.read_log(spark, path, LOG_SCHEMA)
    return log.groupBy("mode", "action").agg(F.count("*").alias("n"))


@query(
    "snk_05_request_dates",
    check_sql("SELECT DISTINCT date FROM requests WHERE date >= DATE '1998-01-01'", "requests"),
)
def request_dates(spark, sf_dir):
    wanted = forecasts.requests(market.panel(spark, sf_dir))
    return sink.write_requests(wanted, staged(spark, "requests"), "1998-01-01")
