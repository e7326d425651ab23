"""Walk-forward, weighting and scoring queries."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from panelworks.catalog import alignment, fundamentals, sizing, tables  # noqa: F401  (shared table expressions)
from panelworks.catalog.base import r4, rnd
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.settings import Fitting, Selection, Setup
from panelworks.operators import walkforward as wf
from panelworks.operators.panel import forward_open_returns
from panelworks.operators.scoring import target_holdings
from panelworks.operators.stage import materialize
from panelworks.operators.xsection import top_n, wide_pct_rank
from panelworks.plans import factor_plan as plan
from panelworks.sources import macro, market

FACTORS = [*tables.TECH, *tables.FUND]
WF = Fitting(train_months=24, test_months=6, step_months=3, least_dates=12, least_symbols=8, scheme="grouped_ic")
STRATEGY = Selection(names=4, half_at=-0.3, none_at=-0.6)
CONFIG = Setup(
    factors=tuple(FACTORS),
    rebalance="monthly",
    needs_trend=False,
    lookbacks=tables.PARAMS,
    eligible=tables.RULES,
    selection=STRATEGY,
    fitting=WF,
)


def fitted_by(scheme: str) -> Setup:
    return replace(CONFIG, fitting=replace(WF, scheme=scheme))



cte("rebal_n", "SELECT date, row_number() OVER (ORDER BY date) AS i, lead(date) OVER (ORDER BY date) AS next_date FROM rebal", ("rebal",))
cte(
    "cursors",
    """SELECT (SELECT min(i) FROM rebal_n WHERE date >= (SELECT min(date) FROM rebal_n) + INTERVAL 2 YEAR) AS i
    UNION ALL SELECT greatest(c.i + 1, (SELECT min(n.i) FROM rebal_n n, rebal_n d WHERE d.i = c.i AND n.date >= d.date + INTERVAL 3 MONTH))
    FROM cursors c WHERE (SELECT min(n.i) FROM rebal_n n, rebal_n d WHERE d.i = c.i AND n.date >= d.date + INTERVAL 3 MONTH) IS NOT NULL""",
    ("rebal_n",),
)
cte(
    "splits",
    """SELECT CAST(row_number() OVER (ORDER BY test_start) - 1 AS INTEGER) AS split_id, * FROM (SELECT s.date AS test_start,
    min(r.date) FILTER (r.date < s.date) AS train_start, max(r.date) FILTER (r.date < s.date) AS train_end,
    max(r.date) FILTER (r.date >= s.date) AS test_end, CAST(count(*) FILTER (r.date < s.date) AS INTEGER) AS n_train,
    CAST(count(*) FILTER (r.date >= s.date) AS INTEGER) AS n_test FROM (SELECT DISTINCT n.date FROM cursors c JOIN rebal_n n USING (i)) s
    JOIN rebal_n r ON r.date >= s.date - INTERVAL 2 YEAR AND r.date < s.date + INTERVAL 6 MONTH GROUP BY s.date)
    WHERE n_train >= 12 AND n_test > 0""",
    ("cursors", "rebal_n"),
)
cte(
    "train",
    """SELECT s.split_id, r.date, r.next_date, s.test_start FROM splits s JOIN rebal_n r
    ON r.date >= s.test_start - INTERVAL 2 YEAR AND r.date < s.test_start""",
    ("splits", "rebal_n"),
)
cte("clean_train", "SELECT split_id, date FROM train WHERE next_date < test_start", ("train",))
cte(
    "assignment",
    """SELECT r.date, min(s.split_id) AS split_id FROM splits s JOIN rebal_n r
    ON r.date >= s.test_start AND r.date < s.test_start + INTERVAL 6 MONTH GROUP BY r.date""",
    ("splits", "rebal_n"),
)
cte(
    "fund_ranks",
    f"""SELECT symbol, date, {', '.join(f'{tables.rank_sql(f)} AS {f}' for f in tables.FUND)} FROM (SELECT symbol, date,
    {', '.join(f'lag({f}) OVER w AS {f}' for f in tables.FUND)} FROM fund_factors WINDOW w AS (PARTITION BY symbol ORDER BY date))
    WHERE date IN (SELECT date FROM rebal)""",
    ("fund_factors", "rebal"),
)
cte("ranks", "SELECT * FROM tech_ranks JOIN fund_ranks USING (symbol, date)", ("tech_ranks", "fund_ranks"))
cte(
    "ic_by_date",
    f"""SELECT factor, date, ic FROM (SELECT factor, date, corr(rx, ry) AS ic, count(*) AS n FROM (SELECT factor, date,
    {tables.rank_sql('x', 'factor, date', '')} AS rx, {tables.rank_sql('y', 'factor, date', '')} AS ry FROM (
    SELECT u.factor, u.symbol, u.date, u.x, f.forward_return AS y FROM (UNPIVOT ranks ON {', '.join(FACTORS)} INTO NAME factor VALUE x) u
    JOIN forward f ON f.symbol = u.symbol AND f.date = u.date WHERE u.x IS NOT NULL AND f.forward_return IS NOT NULL))
    GROUP BY factor, date) WHERE n >= 8 AND ic IS NOT NULL AND NOT isnan(ic)""",
    ("ranks", "forward"),
)
cte(
    "ic_scores",
    f"""SELECT s.split_id, f.factor, coalesce(avg(i.ic), 0) AS ic FROM splits s CROSS JOIN (SELECT unnest({FACTORS!r}) AS factor) f
    LEFT JOIN clean_train t ON t.split_id = s.split_id LEFT JOIN ic_by_date i ON i.factor = f.factor AND i.date = t.date
    GROUP BY 1, 2""",
    ("splits", "clean_train", "ic_by_date"),
)
NORMAL = "CASE WHEN sum(abs(ic)) OVER {w} = 0 THEN 1.0 / count(*) OVER {w} ELSE ic / sum(abs(ic)) OVER {w} END"
cte(
    "weights",
    f"""SELECT split_id, factor, CASE WHEN fund THEN 0.25 ELSE 0.75 END * {NORMAL.format(w='(PARTITION BY split_id, fund)')} AS weight
    FROM (SELECT *, factor IN ('asset_growth', 'earnings_yield', 'roa') AS fund FROM ic_scores)""",
    ("ic_scores",),
)
cte(
    "wf_raw",
    f"""SELECT u.symbol, u.date, a.split_id, sum(coalesce(u.x, 0) * w.weight) AS score FROM (
    {' UNION ALL '.join(f"SELECT symbol, date, '{f}' AS factor, {f} AS x FROM ranks" for f in FACTORS)}) u
    JOIN assignment a ON a.date = u.date JOIN weights w ON w.split_id = a.split_id AND w.factor = u.factor GROUP BY 1, 2, 3""",
    ("ranks", "assignment", "weights"),
)
cte(
    "wf_scores",
    "SELECT r.symbol, r.date, r.score FROM wf_raw r JOIN mask m ON m.symbol = r.symbol AND m.date = r.date WHERE m.eligible AND r.score > 1e-9",
    ("wf_raw", "mask"),
)
cte(
    "macro_known",
    "SELECT date, lag(macro_composite) OVER (ORDER BY date) AS macro_score FROM macro_composite",
    ("macro_composite",),
)
cte(
    "target_counts",
    """SELECT date, macro_score, CASE WHEN macro_score IS NULL THEN 4 WHEN macro_score <= -0.6 THEN 0 WHEN macro_score <= -0.3 THEN 2
    ELSE 4 END AS n FROM macro_known""",
    ("macro_known",),
)
cte(
    "wf_plan",
    """SELECT date, rank, symbol, score FROM (SELECT s.*, t.n, CAST(row_number() OVER (PARTITION BY s.date ORDER BY score DESC, symbol) AS INTEGER) AS rank
    FROM wf_scores s JOIN target_counts t USING (date)) WHERE rank <= n""",
    ("wf_scores", "target_counts"),
)


def context(spark, sf_dir, by: str = "brand") -> plan.MarketContext:
    p = market.stored_panel(spark, sf_dir, by)
    known = macro.known_at_open(macro.order_composite(spark, sf_dir), "macro_score").select("date", "macro_score")
    snaps = tables.snapshots(spark, sf_dir, by)
    return plan.MarketContext(
        panel=p,
        membership=tables.membership(spark, sf_dir, by),
        macro=known,
        fundamentals=tables.records(spark, sf_dir, p.prices, names=tables.FUND, by=by),
        holdings=tables.current_holdings(snaps),
    )


def _monthly(spark, sf_dir):
    return tables.monthly(market.panel(spark, sf_dir))


@query(
    "wf_01_splits",
    check_sql("SELECT split_id, train_start, train_end, test_start, test_end, n_train, n_test FROM splits", "splits"),
)
def splits(spark, sf_dir):
    return wf.build_splits(_monthly(spark, sf_dir), WF).drop("train_lo", "test_hi")


@query("wf_02_first_split_wins", check_sql("SELECT date, split_id FROM assignment", "assignment"))
def assignment(spark, sf_dir):
    days = _monthly(spark, sf_dir)
    return wf.assign_test_dates(wf.build_splits(days, WF), days)


@query("wf_03_clean_train_dates", check_sql("SELECT split_id, date FROM clean_train", "clean_train"))
def clean_train(spark, sf_dir):
    days = _monthly(spark, sf_dir)
    return wf.strip_leaky(wf.train_dates(wf.build_splits(days, WF), days))


@query("wf_04_information_coefficients", check_sql("SELECT factor, date, round(ic, 6) AS ic FROM ic_by_date", "ic_by_date"))
def coefficients(spark, sf_dir):
    ctx = context(spark, sf_dir)
    days = tables.monthly(ctx.panel)
    ranks, _, factors = plan.ranked_factors(ctx, CONFIG, days)
    return r4(wf.information_coefficients(ranks, forward_open_returns(ctx.panel.prices, days), factors, 8), "ic", digits=6)


@query(
    "wf_05_normalized_scores",
    check_sql(
        f"SELECT split_id, factor, round({NORMAL.format(w='(PARTITION BY split_id)')}, 6) AS weight FROM ic_scores", "ic_scores"
    ),
)
def normalized(spark, sf_dir):
    config = fitted_by("ic")
    return r4(plan.build_factor_state(context(spark, sf_dir), config).weights, "weight", digits=6)


@query(
    "wf_06_explicit_group_weights",
    check_sql(
        """SELECT split_id, factor, round(CASE factor WHEN 'asset_growth' THEN 0.075 * 2 / 3 WHEN 'earnings_yield' THEN 0.075 / 3
        WHEN 'roa' THEN 0 ELSE 0.925 / 3 END, 6) AS weight FROM ic_scores""",
        "ic_scores",
    ),
)
def explicit_weights(spark, sf_dir):
    days = _monthly(spark, sf_dir)
    names = spark.createDataFrame([(f, 0.0) for f in FACTORS], "factor string, ic double")
    scores = wf.build_splits(days, WF).select("split_id").crossJoin(F.broadcast(names))
    given = {"asset_growth": 2.0, "earnings_yield": 1.0, "roa": -1.0}
    return r4(wf.grouped_weights(scores, False, 0.075, given), "weight", digits=6)


@query(
    "wf_07_weighting_schemes",
    check_sql(
        """SELECT 'grouped_ic' AS scheme, split_id, factor, round(weight, 6) AS weight FROM weights
        UNION ALL SELECT 'grouped_equal', split_id, factor, round(CASE WHEN factor IN ('asset_growth', 'earnings_yield', 'roa') THEN 0.25 ELSE 0.75 END / 3, 6) FROM weights
        UNION ALL SELECT 'legacy_equal', split_id, factor, round(1.0 / 6, 6) FROM weights""",
        "weights",
    ),
)
def schemes(spark, sf_dir):
    state = plan.build_factor_state(context(spark, sf_dir), CONFIG)
    parts = [("grouped_ic", state.weights)]
    parts.append(("grouped_equal", wf.fit_weights(state.coefficients, fitted_by("grouped_equal").fitting)))
    parts.append(("legacy_equal", wf.fit_weights(state.coefficients, fitted_by("equal").fitting)))
    tagged = [w.select(F.lit(n).alias("scheme"), "split_id", "factor", rnd("weight", "weight", 6)) for n, w in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query(
    "wf_08_target_holdings",
    check_sql("SELECT date, round(macro_score, 4) AS macro_score, n FROM target_counts", "target_counts"),
)
def target_counts(spark, sf_dir):
    known = macro.known_at_open(macro.order_composite(spark, sf_dir), "macro_score")
    return known.select("date", rnd("macro_score", "macro_score"), target_holdings("macro_score", STRATEGY).alias("n"))


@query(
    "wf_09_scored_universe",
    check_sql("SELECT symbol, date, round(score, 6) AS score FROM wf_scores", "wf_scores"),
)
def scored_universe(spark, sf_dir):
    state = plan.build_factor_state(context(spark, sf_dir), CONFIG)
    return r4(plan.scored(state, CONFIG), "score", digits=6)


@query(
    "wf_10_composite_with_override",
    check_sql(
        """SELECT r.symbol, r.date, round(r.score + (coalesce(-k.breakout, 0) - coalesce(k.breakout, 0)) * w.weight + 0.1 * coalesce(k.sma_crossover, 0), 6) AS score
        FROM wf_raw r JOIN mask m ON m.symbol = r.symbol AND m.date = r.date JOIN ranks k ON k.symbol = r.symbol AND k.date = r.date
        JOIN weights w ON w.split_id = r.split_id AND w.factor = 'breakout' JOIN target_counts t ON t.date = r.date
        WHERE m.eligible AND t.n > 0""",
        "wf_raw",
        "mask",
        "ranks",
        "weights",
        "target_counts",
    ),
)
def overridden(spark, sf_dir):
    config = replace(CONFIG, selection=replace(STRATEGY, positive_only=False))
    state = plan.build_factor_state(context(spark, sf_dir), config)
    ranks = state.ranks.withColumns({"flipped": -F.col("breakout"), "boost": F.col("sma_crossover")})
    out = plan.composite_scores(state, config, {"breakout": "flipped"}, {"boost": 0.1}, ranks)
    return r4(out, "score", digits=6)


@query(
    "wf_11_walk_forward_plan",
    check_sql("SELECT date, rank, symbol, round(score, 6) AS score FROM wf_plan", "wf_plan"),
)
def walk_forward_plan(spark, sf_dir):
    state = plan.build_factor_state(context(spark, sf_dir), CONFIG)
    return r4(plan.walk_forward_plan(state, CONFIG), "score", digits=6)


@query(
    "wf_11_split_diagnostics",
    check_sql(
        """SELECT s.split_id, s.train_start, s.train_end, s.test_start, s.test_end, coalesce(a.n, 0) AS test_dates,
        round(w.weight, 6) AS breakout_weight FROM splits s LEFT JOIN (SELECT split_id, count(*) AS n FROM assignment GROUP BY 1) a USING (split_id)
        JOIN weights w ON w.split_id = s.split_id AND w.factor = 'breakout'""",
        "splits",
        "assignment",
        "weights",
    ),
)
def diagnostics(spark, sf_dir):
    out = plan.split_diagnostics(plan.build_factor_state(context(spark, sf_dir), CONFIG))
    return out.withColumn("breakout_weight", F.round(F.col("weights")["breakout"], 6)).drop("weights")


LIVE = date(2000, 9, 14)
cte(
    "live_ic",
    """SELECT factor, coalesce(avg(ic) FILTER (date IN (SELECT date FROM rebal_n WHERE date >= DATE '1998-09-14'
    AND date < DATE '2000-09-14' AND next_date < DATE '2000-09-14')), 0) AS ic FROM ic_by_date GROUP BY factor""",
    ("ic_by_date", "rebal_n"),
)
cte(
    "live_known",
    f"""SELECT t.*, {', '.join(tables.FUND)} FROM tech_known t JOIN (SELECT symbol, date,
    {', '.join(f'lag({f}) OVER w AS {f}' for f in tables.FUND)} FROM fund_factors WINDOW w AS (PARTITION BY symbol ORDER BY date)) f
    USING (symbol, date) WHERE t.date = DATE '2000-09-14'""",
    ("tech_known", "fund_factors"),
)
cte(
    "live_ranks",
    f"SELECT symbol, date, {', '.join(f'{tables.rank_sql(f)} AS {f}' for f in FACTORS)} FROM live_known",
    ("live_known",),
)


@query(
    "wf_12_live_screen",
    check_sql(
        f"""SELECT s.date, s.rank, s.symbol, round(s.score, 6) AS score, h.name, h.sector, round(h.weight_pct, 4) AS etf_weight_pct,
        round(s.macro_score, 4) AS macro_composite FROM (SELECT r.*, CAST(row_number() OVER (ORDER BY r.score DESC, r.symbol) AS INTEGER) AS rank, t.n, t.macro_score FROM (
        SELECT u.symbol, u.date, sum(coalesce(u.x, 0) * w.weight) AS score FROM (
        {' UNION ALL '.join(f"SELECT symbol, date, '{f}' AS factor, {f} AS x FROM live_ranks" for f in FACTORS)}) u
        JOIN (SELECT factor, CASE WHEN fund THEN 0.25 ELSE 0.75 END * {NORMAL.format(w='(PARTITION BY fund)')} AS weight
        FROM (SELECT *, factor IN ('asset_growth', 'earnings_yield', 'roa') AS fund FROM live_ic)) w USING (factor) GROUP BY 1, 2) r
        JOIN mask m ON m.symbol = r.symbol AND m.date = r.date JOIN target_counts t ON t.date = r.date
        WHERE m.eligible AND r.score > 1e-9) s LEFT JOIN current_holdings h ON h.ticker = s.symbol WHERE s.rank <= s.n""",
        "live_ranks",
        "live_ic",
        "mask",
        "target_counts",
        "current_holdings",
    ),
)
def live_screen(spark, sf_dir):
    out = plan.live_screen(context(spark, sf_dir), CONFIG, LIVE)
    out = r4(r4(out, "score", digits=6), "etf_weight_pct", "macro_composite")
    return out.select("date", "rank", "symbol", "score", "name", "sector", "etf_weight_pct", "macro_composite")


ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)
cte(
    "blend_picks",
    f"""SELECT CAST(alpha AS DOUBLE) AS alpha, date, symbol, rank FROM (SELECT alpha, date, symbol, CAST(row_number() OVER (PARTITION BY alpha, date ORDER BY blended DESC, symbol) AS INTEGER) AS rank
    FROM (SELECT a.alpha, s.date, s.symbol, (1 - a.alpha) * s.score + a.alpha * coalesce(s.f, s.score) AS blended FROM (
    SELECT date, symbol, score, {tables.rank_sql('return_21', centre='')} AS f FROM judged WHERE reason IS NULL) s,
    (VALUES {', '.join(f'({a})' for a in ALPHAS)}) a(alpha))) WHERE rank <= 2""",
    ("judged",),
)


def blend_picks(spark, sf_dir, p):
    """The two best names per date and alpha, after the vetoes, of the composite blended with the rank of the stored
    21-day forecast return."""
    alphas = spark.createDataFrame([(a,) for a in ALPHAS], "alpha double")
    judged = materialize(sizing.judged_scores(spark, sf_dir, p, sizing.RULES).where("reason IS NULL"), "judged")
    ranked = wide_pct_rank(judged.select("date", "symbol", "score", "return_21"), "return_21", out="f")
    blended = ranked.crossJoin(F.broadcast(alphas)).withColumn(
        "score", (1 - F.col("alpha")) * F.col("score") + F.col("alpha") * F.coalesce("f", "score")
    )
    return top_n(blended, 2, ["alpha", "date"]).select("alpha", "date", "symbol", "rank")


@query("wf_13_alpha_blend", check_sql("SELECT alpha, date, symbol, rank FROM blend_picks", "blend_picks"))
def alpha_blend(spark, sf_dir):
    return blend_picks(spark, sf_dir, market.stored_panel(spark, sf_dir))


cte(
    "alpha_targets",
    """SELECT CAST(alpha AS VARCHAR) AS run_id, date, rank, symbol, 1.0 / count(*) OVER (PARTITION BY alpha, date) AS weight
    FROM blend_picks""",
    ("blend_picks",),
)
