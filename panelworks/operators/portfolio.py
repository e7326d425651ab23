"""Valuation of target weights in closed form, trades, and rebalance plans.

``targets`` is (run_id, date, rank, symbol, weight); a decision to hold nothing is a row whose symbol is
NULL. Everything is keyed by run, so thousands of runs are valued together. Portfolio sets and the
calendar are small per run; prices join on (symbol, month), which keeps the work near the output size.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from panelworks.functions.scalar import ratio
from panelworks.operators.stage import materialize

def _by_run() -> WindowSpec:
    return Window.partitionBy("run_id").orderBy("date")


@dataclass(frozen=True)
class Valuation:
    """``positions``: one row per name and holding period (shares, cost, open prices).
    ``periods``: cash per run from ``date`` to before ``until``."""

    positions: DataFrame
    periods: DataFrame


def executed(targets: DataFrame, px: DataFrame, skip_unchanged: bool) -> DataFrame:
    """Targets that trade, with open price and the run's next trading date. A rebalance is skipped when
    its set of names equals what is held, even if weights moved; an empty one is never skipped."""
    wanted = targets.filter("symbol is null or weight > 0").join(
        px.select("symbol", "date", F.col("open_px").alias("open")), ["symbol", "date"], "left"
    )
    priced = F.when(F.col("open") > 0, F.col("symbol"))
    sets = wanted.groupBy("run_id", "date").agg(
        F.array_sort(F.collect_set("symbol")).alias("_want"),
        F.array_sort(F.collect_set(priced)).alias("_got"),
        F.sum("weight").alias("_total"),
    )
    if skip_unchanged:
        held = F.lag("_got").over(_by_run())
        same = (F.size("_want") > 0) & F.coalesce(F.col("_want") == held, F.lit(False))
        sets = sets.withColumn("_same", same).filter("not _same")
    kept = sets.select("run_id", "date", "_total", F.lead("date").over(_by_run()).alias("until"))
    return wanted.join(kept, ["run_id", "date"])


def value(
    targets: DataFrame,
    px: DataFrame,
    cost: float | str,
    capital: float,
    skip_unchanged: bool = True,
    sequential: bool = True,
) -> Valuation:
    """Sell everything at the open, buy the targets, per executed rebalance.

    ``sequential`` buys each name with its weight of the cash that the names before it left over, so the
    rank order matters; otherwise every name gets its weight of the cash at hand. ``cost`` is a rate
    per side, or the column of ``targets`` that holds it.
    """
    rate = F.col(cost) if isinstance(cost, str) else F.lit(float(cost))
    t = executed(materialize(targets, "targets"), px, skip_unchanged)
    scale = F.when(F.col("_total") > 1 + 1e-9, F.col("_total")).otherwise(F.lit(1.0))
    priced = F.col("open") > 0
    t = t.withColumn("weight", F.when(priced, F.col("weight") / scale))
    before = Window.partitionBy("run_id", "date").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.product(1 - F.col("weight")).over(before), F.lit(1.0)) if sequential else F.lit(1.0)
    exits = px.select("symbol", F.col("date").alias("until"), F.col("open_px").alias("open_next"))
    fills = t.withColumn("eff", F.col("weight") * left).join(exits, ["symbol", "until"], "left")
    # everything below reads the fills, several times over
    fills = materialize(fills.select("run_id", "date", "until", "rank", "symbol", "open", "open_next", "eff", rate.alias("_cost")), "fills")
    after = 1 - F.col("_cost")
    grown = F.col("eff") * after * after * ratio("open_next", "open")
    periods = fills.groupBy("run_id", "date", "until").agg(
        (1 - F.coalesce(F.sum("eff"), F.lit(0.0))).alias("_rest"), F.coalesce(F.sum(grown), F.lit(0.0)).alias("_grown")
    )
    growth = F.product(F.col("_rest") + F.col("_grown")).over(_by_run().rowsBetween(Window.unboundedPreceding, -1))
    periods = periods.withColumn("capital", capital * F.coalesce(growth, F.lit(1.0)))
    bought = fills.filter("eff is not null").join(periods.select("run_id", "date", "capital"), ["run_id", "date"])
    positions = bought.select(
        "run_id",
        "date",
        "until",
        "rank",
        "symbol",
        "open",
        "open_next",
        "capital",
        (F.col("capital") * F.col("eff")).alias("cost_basis"),
        ratio(F.col("capital") * F.col("eff") * after, "open").alias("shares"),
    )
    cash = periods.select("run_id", "date", "until", (F.col("capital") * F.col("_rest")).alias("cash"))
    return Valuation(positions, cash)


def equal_targets(targets: DataFrame) -> DataFrame:
    """Same weight for every name of a decision."""
    n = F.count("symbol").over(Window.partitionBy("run_id", "date"))
    return targets.withColumn("weight", F.when(F.col("symbol").isNotNull(), F.lit(1.0) / n))


def equity_curve(v: Valuation, px: DataFrame, sessions: DataFrame, capital: float, start: str | None = None) -> DataFrame:
    """(run_id, date, equity) at every session's close; before its first trade a run holds its cash."""
    days = sessions.select("date") if start is None else sessions.filter(F.col("date") >= F.lit(start).cast("date"))
    bounds = days.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    idle = v.periods.groupBy("run_id").agg(F.min("date").alias("until")).crossJoin(F.broadcast(bounds))
    idle = idle.select("run_id", F.col("_lo").alias("date"), "until", F.lit(float(capital)).alias("cash")).filter("date < until")

    def by_month(spans: DataFrame) -> DataFrame:
        """Holding spans cut at month ends: (…, from, to, month) rows that equi-join with sessions."""
        end = F.coalesce(F.date_sub("until", 1), F.col("_hi"))
        clipped = spans.crossJoin(F.broadcast(bounds)).withColumn("_to", end)
        clipped = clipped.withColumn("_from", F.greatest("date", "_lo")).filter("_from <= _to").drop("date", "until")
        months = F.sequence(F.trunc("_from", "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))
        return clipped.withColumn("month", F.explode(months))

    inside = (F.col("date") >= F.col("_from")) & (F.col("date") <= F.col("_to"))
    calendar = days.withColumn("month", F.trunc("date", "month"))
    cash = by_month(v.periods.unionByName(idle)).join(F.broadcast(calendar), "month").filter(inside)
    marks = px.select("symbol", "date", "close_px", F.trunc("date", "month").alias("month"))
    held = by_month(v.positions.select("run_id", "date", "until", "symbol", "shares"))
    stock = held.join(marks, ["symbol", "month"]).filter(inside)
    rows = cash.select("run_id", "date", F.col("cash").alias("_v")).unionByName(
        stock.select("run_id", "date", (F.col("shares") * F.col("close_px")).alias("_v"))
    )
    return rows.groupBy("run_id", "date").agg(F.sum("_v").alias("equity"))


def trades(v: Valuation, px: DataFrame, sessions: DataFrame, cost: float) -> DataFrame:
    """One row per fill. Names still held after the last session are sold at its close."""
    last = sessions.agg(F.max("date").alias("_last"))
    finals = px.join(F.broadcast(last), F.col("date") == F.col("_last")).select(
        "symbol", "_last", F.col("close_px").alias("_final")
    )
    p = v.positions
    buys = p.select(
        "run_id",
        "date",
        F.lit("BUY").alias("action"),
        "symbol",
        "shares",
        F.col("open").alias("price"),
        (F.col("cost_basis") * cost).alias("fee"),
        F.lit(None).cast("double").alias("pnl"),
        F.lit("rebalance").alias("reason"),
    )
    sold = p.join(finals, "symbol", "left").withColumn("price", F.coalesce("open_next", "_final"))
    gross = F.col("shares") * F.col("price")
    sells = sold.select(
        "run_id",
        F.coalesce("until", "_last").alias("date"),
        F.lit("SELL").alias("action"),
        "symbol",
        "shares",
        "price",
        (gross * cost).alias("fee"),
        (gross * (1 - cost) - F.col("cost_basis")).alias("pnl"),
        F.when(F.col("until").isNull(), "final").otherwise("rebalance").alias("reason"),
    )
    return buys.unionByName(sells.filter("price is not null"))


def selection_log(targets: DataFrame) -> DataFrame:
    """Names of each decision in rank order."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("symbol").isNotNull(), F.struct("rank", "symbol"))))
    names = F.transform(ordered, lambda x: x["symbol"])
    return targets.groupBy("run_id", "date").agg(
        F.array_join(names, ",").alias("symbols"), F.count("symbol").alias("num_symbols")
    )


HELD_SCHEMA = "run_id string, date date, symbol string, shares double, cash double"


def keep_overlap(selections: DataFrame, px: DataFrame, cost: float, capital: float) -> Valuation:
    """Names that stay are not touched: leavers are sold and the cash is split over the newcomers.

    What a rebalance can buy depends on all earlier ones, so the holdings are carried in order, one run
    per group; a group holds decisions x names ever selected of one run. Prices are joined beforehand and
    the daily curve is computed set-wise afterwards.
    """
    selections = materialize(selections.select("run_id", "date", "rank", "symbol"), "selections")
    dates = selections.select("run_id", "date").distinct()
    names = selections.filter("symbol is not null").select("run_id", "symbol").distinct()
    opens = px.select("symbol", "date", F.col("open_px").alias("open"))
    book = (
        dates.join(names, "run_id")
        .join(opens, ["symbol", "date"], "left")
        .join(selections.select("run_id", "date", "symbol", "rank"), ["run_id", "date", "symbol"], "left")
        .unionByName(dates, allowMissingColumns=True)
    )

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        cash, held, out = capital, {}, []
        for day, group in rows.sort_values(["date", "rank"]).groupby("date", sort=True):
            opens = {s: p for s, p in zip(group["symbol"], group["open"]) if isinstance(s, str)}
            wanted = [s for s in group.loc[group["rank"].notna(), "symbol"]]
            for s in [s for s in held if s not in wanted and pd.notna(opens.get(s))]:
                cash += held.pop(s) * opens[s] * (1 - cost)
            new = [s for s in wanted if s not in held]
            stake = cash / len(new) if new else 0.0
            for s in new:
                price = opens.get(s)
                if price is None or pd.isna(price) or price <= 0 or stake <= 0:
                    continue
                held[s] = stake * (1 - cost) / price
                cash -= stake
            run = group["run_id"].iloc[0]
            out.append((run, day, None, None, cash))
            out += [(run, day, s, n, None) for s, n in held.items()]
        return pd.DataFrame(out, columns=["run_id", "date", "symbol", "shares", "cash"])

    state = materialize(book.groupBy("run_id").applyInPandas(carry, HELD_SCHEMA), "held")
    until = dates.select("run_id", "date", F.lead("date").over(_by_run()).alias("until"))
    dated = state.join(until, ["run_id", "date"])
    periods = dated.filter("symbol is null").select("run_id", "date", "until", "cash")
    return Valuation(dated.filter("symbol is not null").select("run_id", "date", "until", "symbol", "shares"), periods)


def rebalance_plan(
    screen: DataFrame, positions: DataFrame, due: bool, full_turnover: bool, names: DataFrame | None = None
) -> DataFrame:
    """Orders that turn current positions into the screen: sells first, then holds, then buys.

    ``screen`` is (symbol, rank, composite_score[, name]); ``positions`` is (symbol, shares)."""
    s = screen.select(
        "symbol",
        F.col("rank").alias("target_rank"),
        "composite_score",
        (F.col("name") if "name" in screen.columns else F.lit(None).cast("string")).alias("_screen_name"),
    )
    s = s.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    both = positions.select("symbol", "shares").join(s, "symbol", "full_outer")
    if names is not None:
        both = both.join(names.select("symbol", F.col("name").alias("_known")), "symbol", "left")
    else:
        both = both.withColumn("_known", F.lit(None).cast("string"))
    both = both.withColumn("name", F.coalesce("_screen_name", "_known"))
    owned, wanted = F.col("shares").isNotNull(), F.col("target_rank").isNotNull()
    if not due:
        plan = both.filter(owned).withColumn("_sides", F.array(F.lit("HOLD")))
    elif full_turnover:
        sides = F.filter(F.array(F.when(owned, "SELL"), F.when(wanted, "BUY")), lambda x: x.isNotNull())
        plan = both.withColumn("_sides", sides)
    else:
        side = F.when(owned & wanted, "HOLD").when(owned, "SELL").otherwise("BUY")
        plan = both.withColumn("_sides", F.array(side))
    plan = plan.withColumn("action", F.explode("_sides"))
    selling, buying = F.col("action") == "SELL", F.col("action") == "BUY"
    priority = F.lit(0) if not due else F.when(selling, 1).when(buying, 3).otherwise(2)
    weight = F.lit(None).cast("double") if not due else F.when(selling, 0.0).otherwise(1.0 / F.col("_n"))
    note = (
        F.lit("Not a rebalance day: keep.")
        if not due
        else F.when(selling, "Left the screen.")
        .when(buying, "New on the screen; buy once sales are done.")
        .otherwise("Still on the screen.")
    )
    return plan.select(
        priority.alias("priority"),
        "action",
        "symbol",
        "name",
        F.when(~buying, F.col("shares")).alias("shares"),
        weight.alias("target_weight"),
        F.when(~selling, F.col("target_rank")).alias("target_rank"),
        "composite_score",
        note.alias("note"),
    )


def orders(plan: DataFrame) -> DataFrame:
    return plan.filter(F.col("action").isin("SELL", "BUY"))


def action_columns() -> list[Column]:
    """Aggregates that count the plan's actions."""
    names = {"SELL": "sell_orders", "BUY": "buy_orders", "HOLD": "hold_positions"}
    return [F.count_if(F.col("action") == action).alias(name) for action, name in names.items()]


def sized_screen(targets: DataFrame, scores: DataFrame, positions: DataFrame, holdings: DataFrame) -> DataFrame:
    """Sized names of one session by weight, with metadata and whether they are already held."""
    by_weight = Window.partitionBy("date").orderBy(F.col("weight").desc(), F.col("rank"))
    held = positions.select("symbol", F.lit(True).alias("_held"))
    meta = holdings.select(F.col("ticker").alias("symbol"), "name", "sector")
    return (
        targets.withColumn("rank", F.row_number().over(by_weight))
        .join(scores.select("date", "symbol", F.col("score").alias("composite_score")), ["date", "symbol"], "left")
        .join(meta, "symbol", "left")
        .join(held, "symbol", "left")
        .withColumn("action", F.when(F.coalesce("_held", F.lit(False)), "HOLD").otherwise("BUY"))
        .drop("_held")
    )
