"""Registry rules as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of yes / no.
TRUE_WORDS = ("sim", "yes", "true", "1", "s")
FALSE_WORDS = ("não", "nao", "no", "false", "0", "n")
COMPETENCE_RE = r"^[0-9]{4}(0[1-9]|1[0-2])$"
OPEN_END = "999999"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_bool(col: Column | str, default: bool = True) -> tuple[Column, Column]:
    """(value, ok): yes/no words, blank -> default, anything else not ok."""
    s = F.lower(F.trim(F.coalesce(_c(col), F.lit(""))))
    value = (F.when(s == "", F.lit(default))
             .when(s.isin(*TRUE_WORDS), F.lit(True))
             .when(s.isin(*FALSE_WORDS), F.lit(False)))
    return value, value.isNotNull()


def competence_valid(col: Column | str) -> Column:
    return F.coalesce(_c(col).rlike(COMPETENCE_RE), F.lit(False))


def slash_competence(col: Column | str) -> Column:
    """``YYYY/MM`` or ``YYYY-MM`` -> ``YYYYMM``; other text unchanged."""
    s = F.trim(_c(col))
    return F.when(s.rlike(r"^[0-9]{4}[/-][0-9]{2}$"),
                  F.concat(F.substring(s, 1, 4), F.substring(s, 6, 2))).otherwise(s)


def mmyyyy_to_yyyymm(col: Column | str) -> Column:
    s = F.trim(_c(col))
    return F.when(s.rlike(r"^[0-9]{6}$"), F.concat(F.right(s, F.lit(4)), F.left(s, F.lit(2))))


def prefix_any(col: Column | str, codes: Sequence[str]) -> Column:
    """Trimmed non-empty value starting with any of ``codes``."""
    s = F.trim(F.coalesce(_c(col), F.lit("")))
    cleaned = [c.strip() for c in codes if c.strip()]
    if not cleaned:
        return F.lit(False)
    cond = F.lit(False)
    for code in cleaned:
        cond = cond | s.startswith(code)
    return (s != "") & cond


def bed_range(col: Column | str, lo: int | None, hi: int | None) -> Column:
    c = _c(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= F.lit(lo))
    if hi is not None:
        cond = cond & (c <= F.lit(hi))
    return cond


def code_label(col: Column | str) -> Column:
    """Dependency level code: 1 -> INDIVIDUAL, 3 -> MANTIDO, else raw (blank -> NULL)."""
    s = F.trim(_c(col))
    return (F.when(s == "1", F.lit("INDIVIDUAL")).when(s == "3", F.lit("MANTIDO"))
            .otherwise(F.nullif(s, F.lit(""))))


def geo_reliable(lat: Column, lon: Column, min_lat: Column, max_lat: Column,
                 min_lon: Column, max_lon: Column) -> Column:
    return F.coalesce(lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon),
                      F.lit(False))


def array_has(arr: Column | str, name: str) -> Column:
    """``array_contains`` treating a NULL array as not containing."""
    return F.coalesce(F.array_contains(_c(arr), F.lit(name)), F.lit(False))


def append_flags(arr: Column | str, flags: Sequence[tuple[Column, Sequence[str]]]) -> Column:
    """Append names to an array when their condition holds (NULL array = empty)."""
    out = F.coalesce(_c(arr), F.array().cast("array<string>"))
    for cond, names in flags:
        out = F.concat(out, F.when(cond, F.array(*[F.lit(n) for n in names]))
                       .otherwise(F.array().cast("array<string>")))
    return out


def dedupe_key(code: Column | str, cnpj: Column | str) -> Column:
    c = _c(cnpj)
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat_ws(":", _c(code), c))
