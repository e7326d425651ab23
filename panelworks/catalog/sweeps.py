"""Sweep and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.catalog import forecasts, metrics, portfolio, sizing, tables, walk_forward
from panelworks.catalog.base import r4
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.operators import metrics as mt
from panelworks.operators import portfolio as pf
from panelworks.operators import sizing as sz
from panelworks.operators import sweeps as sw
from panelworks.operators import walkforward as wf
from panelworks.operators.eligibility import eligible_symbols
from panelworks.operators.panel import trade_prices
from panelworks.operators.stage import materialize
from panelworks.operators.xsection import top_n
from panelworks.sources import market

cte(
    "noisy_targets",
    """SELECT run_id, date, CAST(rank AS INTEGER) AS rank, symbol, 1.0 / count(*) OVER (PARTITION BY run_id, date) AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, date ORDER BY score DESC, symbol) AS rank FROM noisy) WHERE rank <= 2""",
    ("noisy",),
)
portfolio.valuation_ctes("nz", "noisy_targets", portfolio.COST, True, True)
metrics.extended_sql("nz_run", "nz_equity", "run_id", ("nz_equity",))
cte("nz_years", "SELECT *, year(date) AS year FROM nz_equity", ("nz_equity",))
metrics.extended_sql("nz_year", "nz_years", "run_id, year", ("nz_years",))
cte(
    "nz_metrics",
    """SELECT run_id, r.sharpe, y.worst_year_sharpe, y.robust_score FROM nz_run r JOIN (SELECT run_id, min(sharpe) AS worst_year_sharpe,
    avg(sharpe) - 0.5 * stddev_pop(sharpe) AS robust_score FROM nz_year GROUP BY run_id) y USING (run_id)""",
    ("nz_run", "nz_year"),
)
ROBUST = ("sharpe", "worst_year_sharpe", "robust_score")


def _run_metrics(p, targets):
    """Metrics of many runs, all valued in one job."""
    px = trade_prices(p.prices)
    v = pf.value(targets, px, portfolio.COST, portfolio.CAPITAL)
    equity = materialize(pf.equity_curve(v, px, p.sessions, portfolio.CAPITAL), "equity")
    bench = market.benchmark(p.prices)
    years = mt.summarize_years(mt.year_metrics(equity, bench))
    return mt.extended_metrics(equity, bench).join(years, "run_id")


@query(
    "sw_01_perturbation_runs",
    check_sql(
        " UNION ALL ".join(
            f"""SELECT '{m}' AS metric, round(avg({m}), 4) AS mean, round(stddev_pop({m}), 4) AS std, count({m}) AS n_runs,
            round(abs(stddev_pop({m}) / nullif(avg({m}), 0)), 4) AS cv, coalesce(abs(stddev_pop({m}) / nullif(avg({m}), 0)) < 0.05, FALSE) AS stable FROM nz_metrics"""
            for m in ROBUST
        ),
        "nz_metrics",
    ),
)
def perturbation_runs(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    noisy = sz.perturb(tables.stored_scores(spark, sf_dir, p), sizing.runs(spark), 0.3)
    targets = sz.top_n_equal_weights(noisy, 2, ["run_id", "date"])
    return r4(sw.run_spread(_run_metrics(p, targets), ROBUST), "mean", "std", "cv")


VARIANTS = [("base", 2, 0.9), ("n1", 1, 0.9), ("n3", 3, 0.9), ("veto_lo", 2, 0.85), ("veto_hi", 2, 0.95)]
cte(
    "variant_targets",
    """SELECT run_id, date, CAST(rank AS INTEGER) AS rank, symbol, 1.0 / count(*) OVER (PARTITION BY run_id, date) AS weight FROM (
    SELECT v.run_id, v.n, s.date, s.symbol, row_number() OVER (PARTITION BY v.run_id, s.date ORDER BY s.score DESC, s.symbol) AS rank
    FROM scores s LEFT JOIN ratios r ON r.symbol = s.symbol AND r.date = s.date CROSS JOIN (VALUES """
    + ", ".join(f"('{r}', {n}, {t})" for r, n, t in VARIANTS)
    + """) v(run_id, n, threshold) WHERE NOT coalesce(r.ratio < v.threshold, FALSE)) WHERE rank <= n""",
    ("scores", "ratios"),
)
portfolio.valuation_ctes("vr", "variant_targets", portfolio.COST, True, True)
metrics.extended_sql("vr_run", "vr_equity", "run_id", ("vr_equity",))
cte("vr_years", "SELECT *, year(date) AS year FROM vr_equity", ("vr_equity",))
metrics.extended_sql("vr_year", "vr_years", "run_id, year", ("vr_years",))


def _variant_metrics(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    params = spark.createDataFrame(VARIANTS, "run_id string, n int, threshold double")
    s = tables.scores(spark, sf_dir, p).join(sizing.ratios(p), ["symbol", "date"], "left")
    kept = s.crossJoin(F.broadcast(params)).filter(~F.coalesce(F.col("ratio") < F.col("threshold"), F.lit(False)))
    best = top_n(kept, F.col("n"), ["run_id", "date"], at_most=3)
    return _run_metrics(p, sz.equal_within(best, ["run_id", "date"]))


@query(
    "sw_02_sensitivity_variants",
    check_sql(
        """SELECT run_id, round(r.sharpe, 4) AS sharpe, round(r.cagr, 4) AS cagr, round(y.w, 4) AS worst_year_sharpe FROM vr_run r
        JOIN (SELECT run_id, min(sharpe) AS w FROM vr_year GROUP BY run_id) y USING (run_id)""",
        "vr_run",
        "vr_year",
    ),
)
def sensitivity_variants(spark, sf_dir):
    out = _variant_metrics(spark, sf_dir).select("run_id", "sharpe", "cagr", "worst_year_sharpe")
    return r4(out, "sharpe", "cagr", "worst_year_sharpe")


@query(
    "sw_02_sensitivity_spread",
    check_sql(
        """SELECT round(max(y.w) - min(y.w), 4) AS worst_spread, round(max(r.sharpe) - min(r.sharpe), 4) AS sharpe_spread,
        round(CASE WHEN max(r.sharpe) > 0 THEN (max(r.sharpe) - min(r.sharpe)) / max(r.sharpe) END, 4) AS sharpe_collapse,
        coalesce(max(y.w) - min(y.w) < 0.5 AND (max(r.sharpe) - min(r.sharpe)) / max(r.sharpe) < 0.3, FALSE) AS passed
        FROM vr_run r JOIN (SELECT run_id, min(sharpe) AS w FROM vr_year GROUP BY run_id) y USING (run_id)""",
        "vr_run",
        "vr_year",
    ),
)
def sensitivity_spread(spark, sf_dir):
    return r4(sw.sensitivity_spread(_variant_metrics(spark, sf_dir)), "worst_spread", "sharpe_spread", "sharpe_collapse")


# A log of experiments: one per brand and year, scored and with a drawdown, in order.
cte(
    "experiments",
    """SELECT year(date) * 100 + CAST(substr(symbol, 7) AS INTEGER) AS experiment, sum(l_extendedprice * l_discount) / sum(l_extendedprice) AS score,
    -max(l_tax) * sum(l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity) * 10 AS max_drawdown FROM trades GROUP BY 1""",
    ("trades",),
)


@query(
    "sw_03_leaderboard",
    check_sql(
        """SELECT CAST(experiment AS INTEGER) AS experiment, round(score, 8) AS score, CASE WHEN abs(max_drawdown) <= 0.28 AND (best IS NULL OR score > best) THEN 'keep' ELSE 'discard' END AS status
        FROM (SELECT *, max(score) FILTER (abs(max_drawdown) <= 0.28) OVER (ORDER BY experiment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM experiments)""",
        "experiments",
    ),
)
def leaderboard(spark, sf_dir):
    key = F.year("date") * 100 + F.substring("symbol", 7, 9).cast("int")
    returned = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))
    log = (
        market.trades(spark, sf_dir)
        .groupBy(key.alias("experiment"))
        .agg(
            (F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice")).alias("score"),
            (-F.max("l_tax") * returned / F.sum("l_quantity") * 10).alias("max_drawdown"),
        )
    )
    return r4(sw.leaderboard(log, "experiment", 0.28).select("experiment", "score", "status"), "score", digits=8)


@query(
    "sw_04_config_difference",
    """SELECT p_partkey, substr(sha1('{"kind":"' || p_type || '","size":' || p_size || '}'), 1, 12) AS config_hash,
    CASE WHEN p_type = 'PROMO' AND p_size = 10 THEN 'baseline' ELSE concat_ws('; ', CASE WHEN p_type <> 'PROMO' THEN 'kind=' || p_type END,
    CASE WHEN p_size <> 10 THEN 'size=' || p_size END) END AS description FROM part""",
)
def config_difference(spark, sf_dir):
    part = market.table(spark, sf_dir, "part")
    base = F.struct(F.lit("PROMO").alias("kind"), F.lit(10).alias("size"))
    params = F.struct(F.col("p_type").alias("kind"), F.col("p_size").alias("size"))
    both = part.select("p_partkey", base.alias("base"), params.alias("candidate"))
    return both.select(
        "p_partkey",
        sw.config_hash(F.col("candidate")).alias("config_hash"),
        sw.describe_difference(["size", "kind"], "base", "candidate").alias("description"),
    )


SPACE = {"breakout": [13.0, 26.0, 52.0], "fast": [3.0, 7.0, 10.0], "slow": [30.0, 50.0, 64.0], "trend": [60.0, 120.0, 201.0]}
BASE = {"breakout": 26.0, "fast": 10.0, "slow": 30.0, "trend": 60.0}
OPTIONS = ", ".join(f"('{p}', {v}::DOUBLE)" for p, vs in SPACE.items() for v in vs if v != BASE[p])


@query(
    "sw_05_candidate_sample",
    f"""WITH drawn AS (SELECT c.candidate_id, o.path, o.value, 1 + CAST(('0x' || substr(md5('42:' || c.candidate_id), 1, 8)) AS BIGINT) % 3 AS k,
    row_number() OVER (PARTITION BY c.candidate_id, o.path ORDER BY md5('42:' || c.candidate_id || ':' || o.path || ':' || o.value)) AS rn
    FROM (SELECT p_partkey AS candidate_id FROM part) c, (VALUES {OPTIONS}) o(path, value)),
    picked AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY md5('42:' || candidate_id || ':' || path)) AS pos FROM drawn WHERE rn = 1),
    made AS (SELECT candidate_id, {', '.join(f"coalesce(max(value) FILTER (path = '{p}'), {BASE[p]}::DOUBLE) AS {p}" for p in sorted(SPACE))} FROM picked WHERE pos <= k GROUP BY 1)
    SELECT min(candidate_id) AS candidate_id, {', '.join(sorted(SPACE))} FROM made GROUP BY {', '.join(sorted(SPACE))}""",
)
def candidate_sample(spark, sf_dir):
    ids = market.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"))
    out = sw.sample_candidates(ids, SPACE, BASE, 3, 42)
    return out.select("candidate_id", *[F.col("params")[p].alias(p) for p in sorted(SPACE)])


@query(
    "au_01_split_leaks",
    check_sql(
        """SELECT (SELECT count(*) FROM splits) AS n_splits, (SELECT count(*) FROM splits WHERE train_end >= test_start) AS overlapping,
        (SELECT count(*) FROM train) AS train_rows, (SELECT count(*) FROM clean_train) AS clean_rows,
        (SELECT count(*) FROM train) - (SELECT count(*) FROM clean_train) AS stripped""",
        "splits",
        "train",
        "clean_train",
    ),
)
def split_leaks(spark, sf_dir):
    days = tables.monthly(market.panel(spark, sf_dir))
    splits = wf.build_splits(days, walk_forward.WF)
    train = wf.train_dates(splits, days)
    return sw.leak_audit(splits, train, wf.strip_leaky(train))


@query(
    "au_02_symbol_coverage",
    check_sql(
        """SELECT coalesce(m.symbol, f.symbol) AS symbol, CASE WHEN f.symbol IS NULL THEN 'missing' WHEN m.symbol IS NULL THEN 'extra' ELSE 'covered' END AS status
        FROM (SELECT DISTINCT symbol FROM mask WHERE eligible) m FULL JOIN
        (SELECT DISTINCT symbol FROM requests) f ON f.symbol = m.symbol""",
        "mask",
        "requests",
    ),
)
def symbol_coverage(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    able = eligible_symbols(tables.mask(spark, sf_dir, p))
    return sw.symbol_coverage(able, forecasts.requests(p))


cte(
    "coverage_by_date",
    """SELECT m.date, count(*) AS eligible, count(*) - count(r.symbol) AS missing, count(r.symbol) = 0 AS zero_coverage FROM mask m
    LEFT JOIN (SELECT * FROM requests WHERE len(series) >= 36) r ON r.symbol = m.symbol AND r.date = m.date
    WHERE m.eligible AND m.date IN (SELECT date FROM rebal) GROUP BY m.date""",
    ("mask", "requests", "rebal"),
)


def _date_coverage(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    ok = eligible_symbols(tables.mask(spark, sf_dir, p)).join(F.broadcast(tables.monthly(p)), "date", "left_semi")
    return sw.date_coverage(ok, forecasts.requests(p).filter(F.size("series") >= 36))


@query("au_02_date_coverage", check_sql("SELECT * FROM coverage_by_date", "coverage_by_date"))
def date_coverage(spark, sf_dir):
    return _date_coverage(spark, sf_dir)


@query(
    "au_02_year_coverage",
    check_sql(
        """SELECT CAST(year(date) AS INTEGER) AS year, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(eligible) AS BIGINT) AS eligible, max(missing) AS worst,
        round(sum(missing) / sum(eligible), 6) AS missing_share FROM coverage_by_date GROUP BY 1""",
        "coverage_by_date",
    ),
)
def year_coverage(spark, sf_dir):
    return r4(sw.yearly_coverage(_date_coverage(spark, sf_dir)), "missing_share", digits=6)


@query(
    "au_03_null_cells",
    check_sql(
        """SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (v IS NULL) AS BIGINT) AS null_cells FROM (
        SELECT unnest([open, high, low, close, volume]) AS v FROM panel)""",
        "panel",
    ),
)
def null_cells(spark, sf_dir):
    prices = market.panel(spark, sf_dir).prices
    packed = prices.select(F.array("open", "high", "low", "close", "volume").alias("cells"))
    return sw.null_cells(packed, "cells")


@query(
    "au_04_point_in_time_lag",
    check_sql("SELECT date, prior_end, CAST(date - prior_end AS INTEGER) AS lag_days, prior_end < date AS ok FROM rebal_prior", "rebal_prior"),
)
def point_in_time(spark, sf_dir):
    return sw.point_in_time(tables.prior_ends(market.panel(spark, sf_dir)))


@query(
    "au_05_selected_without_forecast",
    check_sql(
        """SELECT CAST(year(p.date) AS INTEGER) AS year, count(*) AS names, count(DISTINCT p.date) AS dates FROM picks p
        ANTI JOIN (SELECT * FROM requests WHERE len(series) >= 40) r ON r.symbol = p.symbol AND r.date = p.date GROUP BY 1""",
        "picks",
        "requests",
    ),
)
def selected_without_forecast(spark, sf_dir):
    p = market.stored_panel(spark, sf_dir)
    have = forecasts.requests(p).filter(F.size("series") >= 40)
    return sw.selected_without_forecast(sizing.picks(spark, sf_dir, p), have)
