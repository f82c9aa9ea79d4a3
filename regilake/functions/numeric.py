"""Numeric parsing and arithmetic helpers (ANSI-safe: every parse is try_*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number: optional sign, digits with optional fraction, optional exponent.
NUMERIC_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def try_bigint(col: Column | str) -> Column:
    """Lenient BIGINT parse: trimmed numeric text rounded half-up, else NULL."""
    s = F.trim(_c(col))
    return F.when(s.rlike(NUMERIC_RE), F.round(s.try_cast("double")).try_cast("bigint"))


def decimal_comma(col: Column | str) -> Column:
    """``'-23,5'`` -> -23.5; invalid -> NULL."""
    s = F.replace(F.trim(_c(col)), F.lit(","), F.lit("."))
    return F.when(s.rlike(NUMERIC_RE), s.try_cast("double"))


def nonneg_int(col: Column | str) -> tuple[Column, Column]:
    """(value, ok) for a bed count: blank -> 0, comma decimal, truncate,
    invalid / negative / non-finite -> not ok."""
    s = F.replace(F.trim(F.coalesce(_c(col), F.lit(""))), F.lit(","), F.lit("."))
    parsed = s.try_cast("double")
    # cast(double as bigint) truncates toward zero, so -0.5 -> 0 is accepted.
    value = F.when(s == "", F.lit(0).cast("bigint")).otherwise(
        F.when(s.rlike(NUMERIC_RE) & (F.abs(parsed) < 9.2e18), parsed.cast("bigint"))
    )
    ok = value.isNotNull() & (value >= 0)
    return value, ok


def range_or_null(col: Column | str, lo: float, hi: float) -> Column:
    c = _c(col)
    return F.when(c.between(lo, hi), c)


def ratio_round(num: Column, den: Column, places: int = 6) -> Column:
    """``round(num/den)`` only when den > 0 and 0 <= num <= den."""
    valid = num.isNotNull() & den.isNotNull() & (den > 0) & (num >= 0) & (num <= den)
    return F.when(valid, F.round(num.cast("double") / den, places))
