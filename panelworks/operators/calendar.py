"""Session calendar operators.

A session table has one row per trading day (at most a few tens of thousands of rows for any market),
so the windows over it that have no partition key stay small whatever the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def first_sessions_of_weeks(sessions: DataFrame) -> DataFrame:
    iso_year = F.extract(F.lit("YEAROFWEEK"), "date")
    return sessions.groupBy(iso_year.alias("iso_year"), F.weekofyear("date").alias("iso_week")).agg(
        F.min("date").alias("date")
    )


def first_sessions_of_months(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(F.trunc("date", "month").alias("month")).agg(F.min("date").alias("date"))


def rebalance_sessions(sessions: DataFrame, frequency: str) -> DataFrame:
    """One column ``date``: the sessions on which the portfolio is rebuilt."""
    frequency = frequency.lower()
    if frequency == "monthly":
        return first_sessions_of_months(sessions).select("date")
    if frequency not in ("weekly", "biweekly"):
        raise ValueError(f"unsupported rebalance frequency: {frequency}")
    weekly = first_sessions_of_weeks(sessions).select("date")
    if frequency == "weekly":
        return weekly
    numbered = weekly.withColumn("rn", F.row_number().over(Window.orderBy("date")))
    return numbered.filter("rn % 2 = 1").select("date")


def neighbours(sessions: DataFrame) -> DataFrame:
    """Each session with its previous and next one."""
    w = Window.orderBy("date")
    return sessions.select(
        "date", F.lag("date").over(w).alias("previous"), F.lead("date").over(w).alias("next")
    )


def is_rebalance(targets: DataFrame, rebalances: DataFrame) -> DataFrame:
    flags = rebalances.select("date", F.lit(True).alias("is_rebalance"))
    return targets.join(F.broadcast(flags), "date", "left").withColumn(
        "is_rebalance", F.coalesce("is_rebalance", F.lit(False))
    )


def day_map(sessions: DataFrame) -> DataFrame:
    """Every calendar day from the first to the last session, with the session at or after it and the
    session strictly before it. Turns calendar look-ups of any number of dates into an equi join."""
    near = neighbours(sessions)
    start = F.when(F.col("previous").isNull(), F.col("date")).otherwise(F.date_add("previous", 1))
    return near.select(
        F.explode(F.sequence(start, F.col("date"))).alias("day"),
        F.col("date").alias("on_or_after"),
        F.col("previous").alias("before"),
    )


def next_or_same(targets: DataFrame, sessions: DataFrame, out: str = "session") -> DataFrame:
    """First session >= ``date``; NULL past the last session. Days before the first session map to it."""
    first = sessions.agg(F.min("date").alias("first_session"))
    days = day_map(sessions).select(F.col("day").alias("date"), F.col("on_or_after").alias(out))
    return (
        targets.join(F.broadcast(days), "date", "left")
        .crossJoin(F.broadcast(first))
        .withColumn(out, F.when(F.col("date") < F.col("first_session"), F.col("first_session")).otherwise(F.col(out)))
        .drop("first_session")
    )


def next_rebalance(targets: DataFrame, sessions: DataFrame, frequency: str, out: str = "next_rebalance") -> DataFrame:
    return next_or_same(targets, rebalance_sessions(sessions, frequency), out)


def previous_session(targets: DataFrame, sessions: DataFrame, out: str = "prior_end") -> DataFrame:
    """Last session strictly before ``date``; the date itself when there is none."""
    last = sessions.agg(F.max("date").alias("last_session"))
    days = day_map(sessions).select(F.col("day").alias("date"), F.col("before").alias(out))
    return (
        targets.join(F.broadcast(days), "date", "left")
        .crossJoin(F.broadcast(last))
        .withColumn(
            out,
            F.when(F.col("date") > F.col("last_session"), F.col("last_session")).otherwise(
                F.coalesce(F.col(out), F.col("date"))
            ),
        )
        .drop("last_session")
    )


def extend_sessions(sessions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Loaded sessions plus the supplied calendar's later ones."""
    last = sessions.agg(F.max("date").alias("last_session"))
    later = calendar.crossJoin(F.broadcast(last)).filter("date > last_session").select("date")
    return sessions.select("date").union(later).distinct()


def month_start_guard(targets: DataFrame, calendar: DataFrame) -> DataFrame:
    """Go / no-go per date: is it a trading day, and is it the first one of its month."""
    first = first_sessions_of_months(calendar).select("month", F.col("date").alias("first_session"))
    days = calendar.select("date", F.lit(True).alias("is_session"))
    return (
        targets.withColumn("month", F.trunc("date", "month"))
        .join(F.broadcast(first), "month", "left")
        .join(F.broadcast(days), "date", "left")
        .select(
            "date",
            "first_session",
            F.coalesce("is_session", F.lit(False)).alias("is_session"),
            F.coalesce(F.col("date") == F.col("first_session"), F.lit(False)).alias("go"),
        )
    )
