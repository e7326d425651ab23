"""Fundamental factor queries."""

from __future__ import annotations


from panelworks.catalog import tables
from panelworks.catalog.base import r4
from panelworks.catalog.registry import check_sql, cte, query
from panelworks.settings import FUNDAMENTAL
from panelworks.operators import fundamentals as fnd
from panelworks.sources import market, statements as stm

cte(
    "item_views",
    """SELECT symbol, freq, item, period_end, value, CASE WHEN freq = 'quarterly' AND count(*) OVER f = 4
    THEN sum(value) OVER f END AS ttm, value / nullif(CASE WHEN freq = 'quarterly' THEN lag(value, 4) OVER w
    ELSE lag(value) OVER w END, 0) - 1 AS yoy FROM chosen WHERE value IS NOT NULL
    WINDOW w AS (PARTITION BY symbol, freq, item ORDER BY period_end),
    f AS (PARTITION BY symbol, freq, item ORDER BY period_end ROWS 3 PRECEDING)""",
    ("chosen",),
)
cte(
    "item_asof",
    """SELECT d.symbol, d.period_end, i.item, coalesce(q.value, a.value) AS latest, coalesce(q.ttm, a.value) AS ttm,
    coalesce(q.yoy, a.yoy) AS yoy FROM statement_dates d CROSS JOIN (SELECT DISTINCT item FROM chosen) i
    ASOF LEFT JOIN (SELECT * FROM item_views WHERE freq = 'quarterly') q
    ON q.symbol = d.symbol AND q.item = i.item AND q.period_end <= d.period_end
    ASOF LEFT JOIN (SELECT * FROM item_views WHERE freq = 'annual') a
    ON a.symbol = d.symbol AND a.item = i.item AND a.period_end <= d.period_end""",
    ("statement_dates", "chosen", "item_views"),
)
cte(
    "item_wide",
    "SELECT symbol, period_end, "
    + ", ".join(
        f"max({v}) FILTER (item = '{i}') AS {i}_{v}" for i in fnd.ITEMS for v in ("latest", "ttm", "yoy")
    )
    + " FROM item_asof GROUP BY 1, 2",
    ("item_asof",),
)
cte(
    "valued",
    """SELECT w.*, w.period_end + 45 AS date, p.close AS price, s.shares, p.close * s.shares AS market_cap,
    e.surprise AS earnings_surprise FROM item_wide w
    ASOF JOIN (SELECT * FROM panel WHERE close IS NOT NULL) p ON p.symbol = w.symbol AND p.date <= w.period_end + 45
    LEFT JOIN shares s ON s.symbol = w.symbol
    ASOF LEFT JOIN (SELECT * FROM earnings WHERE surprise IS NOT NULL) e ON e.symbol = w.symbol AND e.date <= w.period_end""",
    ("item_wide", "panel", "shares", "earnings"),
)
cte(
    "fund_records",
    """SELECT symbol, date, equity_latest / nullif(market_cap, 0) AS book_to_market,
    net_income_ttm / nullif(market_cap, 0) AS earnings_yield, net_income_ttm / nullif(assets_latest, 0) AS roa,
    net_income_ttm / nullif(equity_latest, 0) AS roe, gross_profit_ttm / nullif(assets_latest, 0) AS gross_profitability,
    -assets_yoy AS asset_growth, -(abs(capex_ttm) / nullif(assets_latest, 0)) AS investment_to_assets,
    -((issuance_ttm + repurchase_ttm) / nullif(assets_latest, 0)) AS net_issuance,
    -((net_income_ttm - operating_cash_flow_ttm) / nullif(assets_latest, 0)) AS accruals,
    operating_cash_flow_ttm / nullif(market_cap, 0) AS cash_flow_yield, earnings_surprise FROM valued""",
    ("valued",),
)
cte(
    "fund_factors",
    "SELECT g.symbol, g.date, "
    + ", ".join(f"t{i}.{f}" for i, f in enumerate(FUNDAMENTAL))
    + " FROM (SELECT symbol, date FROM symbols, sessions) g "
    + " ".join(
        f"""ASOF LEFT JOIN (SELECT symbol, date, {f} FROM fund_records WHERE {f} IS NOT NULL) t{i}
        ON t{i}.symbol = g.symbol AND t{i}.date <= g.date"""
        for i, f in enumerate(FUNDAMENTAL)
    ),
    ("symbols", "sessions", "fund_records"),
)


def _snapshots(spark, sf_dir):
    rows = tables.statements(spark, sf_dir)
    return fnd.item_snapshots(stm.choose_labels(rows, stm.label_table(spark)), rows.select("symbol", "period_end"))


def _wide(name: str, view: str, suffix: str) -> None:
    cols = [f"{i}_{view}" for i in fnd.ITEMS]
    picked = ", ".join(f"round({c}, 6) AS {c}" for c in cols)

    @query(name, check_sql(f"SELECT symbol, period_end, {picked} FROM item_wide", "item_wide"))
    def run(spark, sf_dir):
        return r4(_snapshots(spark, sf_dir).select("symbol", "period_end", *cols), *cols, digits=6)


_wide("fnd_01_latest_value", "latest", "latest")
_wide("fnd_02_ttm_value", "ttm", "ttm")


@query(
    "fnd_03_year_over_year",
    check_sql("SELECT symbol, period_end, round(assets_yoy, 6) AS assets_yoy, round(equity_yoy, 6) AS equity_yoy FROM item_wide", "item_wide"),
)
def yoy(spark, sf_dir):
    out = _snapshots(spark, sf_dir).select("symbol", "period_end", "assets_yoy", "equity_yoy")
    return r4(out, "assets_yoy", "equity_yoy", digits=6)


@query(
    "fnd_04_earnings_surprise",
    check_sql(
        """SELECT d.symbol, d.period_end, round(e.surprise, 6) AS earnings_surprise FROM statement_dates d
        ASOF LEFT JOIN (SELECT * FROM earnings WHERE surprise IS NOT NULL) e ON e.symbol = d.symbol AND e.date <= d.period_end""",
        "statement_dates",
        "earnings",
    ),
)
def surprise(spark, sf_dir):
    dates = tables.statements(spark, sf_dir).select("symbol", "period_end").distinct()
    return r4(fnd.with_surprise(dates, tables.earnings(spark, sf_dir)), "earnings_surprise", digits=6)


@query(
    "fnd_05_market_value",
    check_sql("SELECT symbol, date, price, shares, round(market_cap, 4) AS market_cap FROM valued", "valued"),
)
def market_value(spark, sf_dir):
    dates = tables.statements(spark, sf_dir).select("symbol", "period_end").distinct()
    prices = market.panel(spark, sf_dir).prices
    out = fnd.with_market_value(dates, prices, tables.company_info(spark, sf_dir), 45)
    return r4(out.drop("period_end"), "market_cap", digits=4)


ROUNDED = ", ".join(f"round({f}, 6) AS {f}" for f in FUNDAMENTAL)


@query("fnd_06_ratios", check_sql(f"SELECT symbol, date, {ROUNDED} FROM fund_records", "fund_records"))
def ratios(spark, sf_dir):
    return r4(tables.records(spark, sf_dir, market.panel(spark, sf_dir).prices), *FUNDAMENTAL, digits=6)


@query("fnd_07_factors_on_sessions", check_sql(f"SELECT symbol, date, {ROUNDED} FROM fund_factors", "fund_factors"))
def on_sessions(spark, sf_dir):
    p = market.panel(spark, sf_dir)
    rows = tables.records(spark, sf_dir, p.prices)
    return r4(fnd.fundamental_factors(rows, p.sessions, p.symbols, FUNDAMENTAL), *FUNDAMENTAL, digits=6)
