"""Scalar column expressions. Missing data is NULL everywhere, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Tickers whose share class is written without a separator.
TICKER_FIXUPS = {"BRKB": "BRK-B", "BFB": "BF-B"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = _col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division whose zero denominator gives NULL, safe under ANSI mode."""
    return F.try_divide(_col(a), _col(b))


def normalize_symbol(c: Column | str) -> Column:
    """Trim, upper-case, use dashes for share classes, then apply the fix-ups."""
    cleaned = F.translate(F.upper(F.trim(_col(c))), "./", "--")
    fixups = F.create_map(*[F.lit(x) for pair in TICKER_FIXUPS.items() for x in pair])
    return F.coalesce(F.element_at(fixups, cleaned), cleaned)


def snapshot_date(stem: Column | str) -> Column:
    """First YYYY-MM-DD or YYYYMMDD in a file stem; NULL when absent or not a date."""
    token = F.regexp_extract(_col(stem), r"(\d{4}-\d{2}-\d{2}|\d{8})", 1)
    return F.coalesce(
        F.try_to_date(F.when(token.contains("-"), token), "yyyy-MM-dd"),
        F.try_to_date(F.when(F.length(token) == 8, token), "yyyyMMdd"),
    )


def first_float(mapping: Column | str, keys: Sequence[str]) -> Column:
    """Value of the first key that parses as a number."""
    m = _col(mapping)
    return F.coalesce(*[F.element_at(m, F.lit(k)).try_cast("double") for k in keys])
