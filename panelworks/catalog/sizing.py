"""Veto, tilt and sizing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.catalog import alignment, forecasts, tables  # noqa: F401  (shared table expressions)
from panelworks.catalog.base import r4, rnd
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.operators import calendar as cal
from panelworks.operators import forecast as fc
from panelworks.operators import sizing as sz
from panelworks.operators import veto as vt
from panelworks.operators.xsection import leader_gap
from panelworks.operators.stage import materialize
from panelworks.sources import forecasts as forecasts_source, market

cte("levels", "SELECT symbol, date, mean[1] AS level FROM mean_forecasts", ("mean_forecasts",))
cte(
    "weekly_prior",
    """SELECT w.date, coalesce((SELECT max(s.date) FROM sessions s WHERE s.date < w.date), w.date) AS prior_end
    FROM weekly_first w""",
    ("weekly_first", "sessions"),
)
TV = """(SELECT symbol, date, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING) AS tv,
    avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) AS tv21 FROM panel)"""
cte(
    "weekly_ratios",
    f"""SELECT v.symbol, w.date, l.level / nullif(v.tv, 0) AS ratio FROM weekly_prior w JOIN {TV} v ON v.date = w.prior_end
    ASOF LEFT JOIN (SELECT DISTINCT date AS made FROM levels) d ON d.made <= w.date
    LEFT JOIN levels l ON l.symbol = v.symbol AND l.date = d.made""",
    ("weekly_prior", "panel", "levels"),
)
cte(
    "ratios",
    f"""SELECT v.symbol, r.date, l.level / nullif(v.tv, 0) AS ratio FROM rebal_prior r JOIN {TV} v ON v.date = r.prior_end
    LEFT JOIN levels l ON l.symbol = v.symbol AND l.date = r.date""",
    ("rebal_prior", "panel", "levels"),
)


def levels(p):
    """Forecast volume levels, stored because every reader would score them again."""
    found = fc.forecast(forecasts.requests(p), fc.trailing_mean_scorer(21), forecasts.HOR, forecasts.CTX, "volume").select(
        "symbol", "date", (fc.mean_sum(21) / 21).alias("level")
    )
    return materialize(found, "levels")


def ratios(p):
    return vt.volume_ratios(levels(p), p.prices, tables.prior_ends(p), 63, fill=False)


@query(
    "vt_01_absolute_veto",
    check_sql(
        "SELECT symbol, date, round(ratio, 4) AS ratio, coalesce(ratio < 0.8, FALSE) AS vetoed FROM weekly_ratios", "weekly_ratios"
    ),
)
def absolute_veto(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    weekly = cal.previous_session(cal.rebalance_sessions(p.sessions, "weekly"), p.sessions)
    return r4(vt.absolute_veto(vt.volume_ratios(levels(p), p.prices, weekly, 63), 0.8), "ratio")


@query(
    "vt_02_relative_veto",
    check_sql(
        """SELECT r.symbol, r.date, round(ratio, 4) AS ratio, coalesce(ratio < cut, FALSE) AS vetoed FROM ratios r LEFT JOIN (
        SELECT date, quantile_cont(ratio, 0.25) AS cut FROM ratios GROUP BY date) q ON q.date = r.date""",
        "ratios",
    ),
)
def relative_veto(spark, sf_dir):
    return r4(vt.relative_veto(ratios(market.stored_panel(spark, sf_dir)), 0.25), "ratio")


@query(
    "vt_03_naive_veto",
    check_sql(
        f"""SELECT v.symbol, r.date, round(v.tv21 / nullif(v.tv, 0), 4) AS ratio, coalesce(v.tv21 / nullif(v.tv, 0) < 0.8, FALSE) AS vetoed
        FROM rebal_prior r JOIN {TV} v ON v.date = r.prior_end""",
        "rebal_prior",
        "panel",
    ),
)
def naive_veto(spark, sf_dir):
    p = market.panel(spark, sf_dir)
    return r4(vt.absolute_veto(vt.naive_ratios(p.prices, tables.prior_ends(p), 63), 0.8), "ratio")


@query(
    "vt_04_soft_veto",
    check_sql(
        """SELECT s.date, s.symbol, round(CASE WHEN r.ratio < 0.7 THEN NULL WHEN r.ratio < 0.95 THEN s.score * r.ratio / 0.95
        WHEN r.ratio > 1 THEN s.score * (1 + 0.5 * (r.ratio - 1)) ELSE s.score END, 6) AS score
        FROM scores s LEFT JOIN ratios r ON r.symbol = s.symbol AND r.date = s.date""",
        "scores",
        "ratios",
    ),
)
def soft_veto(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    both = tables.scores(spark, sf_dir, p).join(ratios(p), ["symbol", "date"], "left")
    adjusted = vt.soft_adjustment(F.col("score"), F.col("ratio"), 0.7, 0.95, 0.5)
    return both.select("date", "symbol", rnd(adjusted, "score", 6))


def judged_scores(spark, sf_dir, p, rules):
    """Scores with the numbers of the forecast store that rules judge, and the first rule that drops each."""
    readings = forecasts_source.readings(spark, forecasts.filled_store(spark, p), forecasts.wanted_readings())
    measures = vt.forecast_measures(readings, p.prices, tables.prior_ends(p))
    return vt.sequential_vetoes(tables.scores(spark, sf_dir, p).join(measures, ["symbol", "date"], "left"), rules)


RETURN_RULE = ("return", "return_21", -0.6)
RULES = (
    ("volume", "volume_ratio", 0.8),
    RETURN_RULE,
    ("short_volume", "short_ratio", 0.6),
    ("price", "price_ratio", 0.8),
    ("return_60", "return_60", -0.3),
    ("return_5", "return_5", -0.2),
)
cte(
    "measures",
    """SELECT f.*, f.volume / nullif(v.tv, 0) AS volume_ratio, f.short_volume / nullif(v.tv, 0) AS short_ratio,
    f.price / CASE WHEN v.close > 0 THEN v.close END AS price_ratio FROM readings f JOIN rebal_prior e ON e.date = f.date
    JOIN (SELECT symbol, date, close, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING) AS tv FROM panel) v
    ON v.symbol = f.symbol AND v.date = e.prior_end""",
    ("readings", "rebal_prior", "panel"),
)
cte(
    "judged",
    f"""SELECT s.date, s.symbol, s.score, m.return_21, CASE {' '.join(f"WHEN m.{c} < {t} THEN '{name}'" for name, c, t in RULES)} END AS reason
    FROM scores s LEFT JOIN measures m ON m.symbol = s.symbol AND m.date = s.date""",
    ("scores", "measures"),
)


@query("vt_05_sequential_vetoes", check_sql("SELECT date, symbol, reason FROM judged", "judged"))
def sequential(spark, sf_dir):
    return judged_scores(spark, sf_dir, market.stored_panel(spark, sf_dir), RULES).select("date", "symbol", "reason")


@query(
    "vt_05_drops_by_reason",
    check_sql("SELECT reason, count(*) AS dropped FROM judged WHERE reason IS NOT NULL GROUP BY reason", "judged"),
)
def drops(spark, sf_dir):
    return vt.rule_counts(judged_scores(spark, sf_dir, market.stored_panel(spark, sf_dir), RULES))


@query(
    "vt_05_return_rule_alone",
    check_sql(f"SELECT date, symbol FROM judged WHERE NOT coalesce(return_21 < {RETURN_RULE[2]}, FALSE)", "judged"),
)
def return_rule_alone(spark, sf_dir):
    judged = judged_scores(spark, sf_dir, market.stored_panel(spark, sf_dir), [RETURN_RULE])
    return judged.where("reason IS NULL").select("date", "symbol")


@query(
    "vt_06_veto_rate",
    check_sql(
        """SELECT count(*) AS scored, count(*) FILTER (r.ratio < 0.9) AS vetoed, round(count(*) FILTER (r.ratio < 0.9) * 1.0 / count(*), 6) AS rate
        FROM scores s LEFT JOIN ratios r ON r.symbol = s.symbol AND r.date = s.date""",
        "scores",
        "ratios",
    ),
)
def veto_rate(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    return r4(vt.veto_rate(tables.scores(spark, sf_dir, p), vt.absolute_veto(ratios(p), 0.9)), "rate", digits=6)


@query(
    "vt_07_alpha_tilt",
    check_sql(
        """SELECT s.date, s.symbol, round(s.score + 0.2 * coalesce(z.z, 0), 6) AS score FROM scores s LEFT JOIN (
        SELECT symbol, date, coalesce((level - avg(level) OVER w) / nullif(stddev_samp(level) OVER w, 0), 0) AS z FROM levels
        WINDOW w AS (PARTITION BY date)) z ON z.symbol = s.symbol AND z.date = s.date""",
        "scores",
        "levels",
    ),
)
def alpha_tilt(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    out = vt.alpha_tilt(tables.scores(spark, sf_dir, p), levels(p), "level", 0.2)
    return r4(out.select("date", "symbol", "score"), "score", digits=6)


cte(
    "picks",
    """SELECT date, symbol, score, rank, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM (SELECT *,
    CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS INTEGER) AS rank FROM scores) WHERE rank <= 3""",
    ("scores",),
)


def picks(spark, sf_dir, p, n=3):
    return sz.top_n_equal_weights(tables.scores(spark, sf_dir, p), n)


@query("sz_01_equal_weights", check_sql("SELECT date, symbol, rank, round(weight, 6) AS weight FROM picks", "picks"))
def equal_weights(spark, sf_dir):
    out = picks(spark, sf_dir, market.stored_panel(spark, sf_dir))
    return r4(out.select("date", "symbol", "rank", "weight"), "weight", digits=6)


cte(
    "prior_vol",
    """SELECT v.symbol, r.date, v.vol FROM rebal_prior r JOIN (SELECT symbol, date, CASE WHEN count(ret) OVER w >= 10
    THEN stddev_samp(ret) OVER w END AS vol FROM changes WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING)) v
    ON v.date = r.prior_end""",
    ("rebal_prior", "changes"),
)
cte(
    "vol_picks",
    """SELECT date, symbol, rank, score, CASE WHEN count(*) OVER w > 1 THEN inv / sum(inv) OVER w ELSE 1 END AS weight FROM (
    SELECT p.*, CASE WHEN v.vol IS NULL THEN 1000 ELSE 1 / greatest(v.vol, 0.001) END AS inv FROM picks p
    LEFT JOIN prior_vol v ON v.symbol = p.symbol AND v.date = p.date) WINDOW w AS (PARTITION BY date)""",
    ("picks", "prior_vol"),
)


@query("sz_02_inverse_volatility", check_sql("SELECT date, symbol, rank, round(weight, 6) AS weight FROM vol_picks", "vol_picks"))
def inverse_volatility(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    vols = sz.prior_volatility(p.prices, tables.prior_ends(p), 21)
    out = sz.inverse_vol_weights(picks(spark, sf_dir, p), vols)
    return r4(out.select("date", "symbol", "rank", "weight"), "weight", digits=6)


cte(
    "gaps",
    """SELECT date, gap FROM (SELECT date, abs(score - lead(score) OVER w) AS gap, row_number() OVER w AS rn FROM scores
    WINDOW w AS (PARTITION BY date ORDER BY score DESC, symbol)) WHERE rn = 1""",
    ("scores",),
)
cte(
    "vol_factor",
    """SELECT r.date, CASE WHEN b.vol > 0 AND m.med > 0 THEN least(2.0, pow(b.vol / m.med, 4)) ELSE 1 END AS vf FROM rebal_prior r
    LEFT JOIN bench_vol b ON b.date = r.prior_end, (SELECT median(b.vol) AS med FROM rebal_prior r JOIN bench_vol b ON b.date = r.prior_end WHERE b.vol > 0) m""",
    ("rebal_prior", "bench_vol"),
)
cte(
    "bench_vol",
    """SELECT date, CASE WHEN count(ret) OVER w >= 5 THEN stddev_samp(ret) OVER w END AS vol FROM (
    SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM bench) WINDOW w AS (ORDER BY date ROWS 20 PRECEDING)""",
    ("bench",),
)


@query(
    "sz_03_conviction_tilt",
    check_sql(
        """SELECT date, symbol, rank, round(CASE WHEN n < 2 OR eff <= 0 THEN weight WHEN rank = 1 THEN least(1, weight + eff)
        ELSE greatest(0, weight - eff / (n - 1)) END, 6) AS weight FROM (SELECT p.*, count(*) OVER (PARTITION BY p.date) AS n,
        least(1, least(0.17, 0.17 * pow(g.gap / m.med, 2)) * f.vf) AS eff FROM picks p JOIN gaps g ON g.date = p.date
        JOIN vol_factor f ON f.date = p.date, (SELECT median(gap) AS med FROM gaps) m)""",
        "picks",
        "gaps",
        "vol_factor",
    ),
)
def conviction_tilt(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    s = tables.stored_scores(spark, sf_dir, p)
    factors = sz.vol_factors(market.benchmark(p.prices), tables.prior_ends(p), 21, 2.0, 4.0)
    context = leader_gap(s).select("date", "gap").crossJoin(F.broadcast(sz.median_gap(s))).join(factors, "date", "left")
    eff = sz.confidence_tilt(F.col("gap"), 0.17, F.col("median_gap"), 2.0, F.col("vol_factor"))
    sized = sz.top_n_equal_weights(s, 3).join(F.broadcast(context.select("date", eff.alias("eff"))), "date")
    out = sz.tilt_to_leader(sized, F.coalesce("eff", F.lit(0.0)))
    return r4(out.select("date", "symbol", "rank", "weight"), "weight", digits=6)


@query(
    "sz_04_gap_and_vol_factor",
    check_sql(
        """SELECT f.date, round(f.vf, 6) AS vol_factor, round(m.med, 6) AS median_gap, round(e.expanding_gap, 6) AS expanding_gap
        FROM vol_factor f CROSS JOIN (SELECT median(gap) AS med FROM gaps) m LEFT JOIN (SELECT date, (SELECT median(h.gap) FROM gaps h
        WHERE h.date <= g.date) AS expanding_gap FROM gaps g WHERE gap IS NOT NULL) e ON e.date = f.date""",
        "vol_factor",
        "gaps",
    ),
)
def gap_and_vol_factor(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    s = tables.stored_scores(spark, sf_dir, p)
    factors = sz.vol_factors(market.benchmark(p.prices), tables.prior_ends(p), 21, 2.0, 4.0)
    so_far = sz.expanding_median_gap(s).withColumnRenamed("median_gap", "expanding_gap")
    out = factors.crossJoin(F.broadcast(sz.median_gap(s))).join(so_far, "date", "left")
    return r4(out, "vol_factor", "median_gap", "expanding_gap", digits=6)


cte(
    "corr_days",
    """SELECT n.date, d.date AS day FROM (SELECT date, row_number() OVER (ORDER BY date) AS i FROM sessions) n
    JOIN (SELECT date, row_number() OVER (ORDER BY date) AS i FROM sessions) d ON d.i < n.i AND d.i >= n.i - 63
    WHERE n.date IN (SELECT date FROM rebal)""",
    ("sessions", "rebal"),
)
cte(
    "leaders",
    "SELECT date, symbol AS leader FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn FROM scores) WHERE rn = 1",
    ("scores",),
)
cte(
    "score_corr",
    """SELECT s.date, s.symbol, CASE WHEN stddev_samp(a.ret) > 0 AND stddev_samp(b.ret) > 0 THEN corr(a.ret, b.ret) END AS c FROM scores s
    JOIN leaders l ON l.date = s.date AND l.leader <> s.symbol JOIN corr_days w ON w.date = s.date
    JOIN changes a ON a.symbol = s.symbol AND a.date = w.day JOIN changes b ON b.symbol = l.leader AND b.date = w.day
    WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2""",
    ("scores", "leaders", "corr_days", "changes"),
)


@query(
    "sz_05_correlation_diversification",
    check_sql(
        """SELECT s.date, s.symbol, round(s.score, 6) AS score FROM scores s JOIN leaders l ON l.date = s.date LEFT JOIN (
        SELECT date, symbol AS partner FROM (SELECT s.date, s.symbol, row_number() OVER (PARTITION BY s.date ORDER BY s.score DESC, s.symbol) AS rn
        FROM scores s JOIN score_corr c USING (date, symbol) WHERE c.c <= 0.05) WHERE rn = 1) p ON p.date = s.date WHERE p.partner IS NULL OR s.symbol IN (l.leader, p.partner)""",
        "scores",
        "leaders",
        "score_corr",
    ),
)
def correlation_diversification(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    out = sz.diversify(tables.stored_scores(spark, sf_dir, p), p.prices, p.sessions, 0.05)
    return r4(out, "score", digits=6)


cte(
    "regime",
    """SELECT r.date, CASE WHEN b.close < b.ma THEN 0.5 ELSE 1 END AS scale FROM rebal_prior r LEFT JOIN (SELECT date, close,
    CASE WHEN count(close) OVER w >= 10 THEN avg(close) OVER w END AS ma FROM bench WINDOW w AS (ORDER BY date ROWS 99 PRECEDING)) b
    ON b.date = r.prior_end""",
    ("rebal_prior", "bench"),
)


@query(
    "sz_06_regime_cash",
    check_sql(
        "SELECT p.date, p.symbol, p.rank, round(p.weight * r.scale, 6) AS weight FROM picks p JOIN regime r ON r.date = p.date",
        "picks",
        "regime",
    ),
)
def regime_cash(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    scale = sz.regime_scale(market.benchmark(p.prices), tables.prior_ends(p), 100, 0.5)
    out = sz.apply_scale(picks(spark, sf_dir, p), scale)
    return r4(out.select("date", "symbol", "rank", "weight"), "weight", digits=6)


RUNS = [f"k{i}" for i in range(8)]
U = "(CAST(('0x' || substr(h, {}, 13)) AS BIGINT) + 0.5) / 4503599627370496.0"
cte(
    "noisy",
    f"""SELECT run_id, date, symbol, noisy AS score FROM (SELECT run_id, date, symbol, score + 0.3 * scale * sqrt(-2 * ln({U.format(1)}))
    * cos(2 * pi() * {U.format(14)}) AS noisy FROM (SELECT r.run_id, s.*, md5(r.run_id || ':' || s.date || ':' || s.symbol) AS h FROM (
    SELECT *, CASE WHEN stddev_samp(score) OVER w > 0 THEN stddev_samp(score) OVER w ELSE 1 END AS scale FROM scores WINDOW w AS (PARTITION BY date)) s,
    (SELECT unnest({RUNS!r}) AS run_id) r)) WHERE noisy > 0""",
    ("scores",),
)


def runs(spark):
    return spark.createDataFrame([(r,) for r in RUNS], "run_id string")


@query("sz_07_score_perturbation", check_sql("SELECT run_id, date, symbol, round(score, 6) AS score FROM noisy", "noisy"))
def perturbation(spark, sf_dir):
    s = tables.scores(spark, sf_dir, market.stored_panel(spark, sf_dir))
    return r4(sz.perturb(s, runs(spark), 0.3), "score", digits=6)
