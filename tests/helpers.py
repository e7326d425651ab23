"""Small frames for the exact-valued cases."""

from datetime import date, timedelta

import pandas as pd
from pyspark.sql import functions as F

from panelworks.operators.panel import densify

D = date.fromisoformat


def rows(frame, *order):
    return [tuple(r) for r in (frame.orderBy(*order) if order else frame).collect()]


def frame(spark, data, schema):
    return spark.createDataFrame([tuple(D(v) if isinstance(v, str) and _is_date(v) else v for v in r) for r in data], schema)


def _is_date(v):
    return len(v) == 10 and v[4] == "-" and v[7] == "-"


def business_days(start, n):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def panel(spark, closes, days=None, volume=5_000_000.0, opens=None):
    """Panel from {symbol: list of closes}; open = high = low = close unless opens are given."""
    data = []
    for symbol, values in closes.items():
        for i, (d, c) in enumerate(zip(days, values)):
            if c is not None:
                o = opens[symbol][i] if opens else c
                data.append((symbol, d, o, float(c), float(c), float(c), volume))
    schema = "symbol string, date date, open double, high double, low double, close double, volume double"
    bars = spark.createDataFrame(data, schema)
    sessions = spark.createDataFrame([(d,) for d in days], "date date")
    symbols = spark.createDataFrame([(s,) for s in closes], "symbol string")
    return densify(bars, sessions, symbols)


def one_key(spark, values, start="2024-01-01"):
    days = [D(start) + timedelta(days=i) for i in range(len(values))]
    return spark.createDataFrame([("A", d, v) for d, v in zip(days, values)], "symbol string, date date, x double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).select(name).collect()]


__all__ = ["D", "F", "business_days", "column", "frame", "one_key", "panel", "rows"]
