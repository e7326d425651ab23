"""Financial statements: wide label x period frames to long rows, and label choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Which statement and which labels, best first, stand for each quantity.
LABELS = {
    "assets": ("balance", ("Total Assets",)),
    "equity": ("balance", ("Stockholders Equity", "Common Stock Equity", "Total Equity Gross Minority Interest")),
    "net_income": ("income", ("Net Income", "Net Income Common Stockholders")),
    "gross_profit": ("income", ("Gross Profit",)),
    "operating_cash_flow": (
        "cashflow",
        (
            "Operating Cash Flow",
            "Cash Flow From Continuing Operating Activities",
            "Net Cash Provided By Operating Activities",
        ),
    ),
    "capex": ("cashflow", ("Capital Expenditure", "Capital Expenditure Reported")),
    "issuance": ("cashflow", ("Issuance Of Capital Stock", "Issuance Of Common Stock")),
    "repurchase": ("cashflow", ("Repurchase Of Capital Stock", "Repurchase Of Common Stock")),
}


def label_table(spark: SparkSession) -> DataFrame:
    rows = [(item, statement, label, i) for item, (statement, labels) in LABELS.items() for i, label in enumerate(labels)]
    return spark.createDataFrame(rows, "item string, statement string, label string, priority int")


def unpivot_statement(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Period columns to rows; a column whose name is not a date is dropped."""
    periods = [c for c in wide.columns if c not in ids]
    quoted = [F.col(f"`{c}`") for c in periods]
    long = wide.unpivot(ids, quoted, "_period", "value")
    return long.withColumn("period_end", F.col("_period").try_cast("date")).filter("period_end is not null").drop("_period")


def choose_labels(statements: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the best label that each symbol's frame has, even where its values are NULL."""
    tagged = statements.join(F.broadcast(labels), ["statement", "label"])
    frame = Window.partitionBy("symbol", "freq", "item")
    best = tagged.withColumn("_best", F.min("priority").over(frame)).filter("priority = _best")
    return best.select("symbol", "freq", "item", "period_end", "value")
