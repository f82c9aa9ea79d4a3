"""Filtered search with a total before paging, and code lookup."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LAKE_COLUMNS, V1_COLUMNS
from .filters import Filters, apply_filters

MAX_LIMIT = 500
# The four supported orders (always ending on the unique code).
ORDERS = {
    "cnes": (("cnes", False),),
    "municipio": (("municipio_normalizado", False), ("cnes", False)),
    "leitos_existentes": (("leitos_existentes", True), ("cnes", False)),
    "leitos_sus": (("leitos_sus", True), ("cnes", False)),
}


def order_columns(order_by: str) -> tuple[Column, ...]:
    if order_by not in ORDERS:
        raise ValueError("unsupported order_by")
    return tuple(F.desc(c) if desc else F.asc(c) for c, desc in ORDERS[order_by])


def search(rows: DataFrame, filters: Filters | Mapping[str, Any] | None = None,
           order_by: str = "cnes", offset: int = 0, limit: int = 50,
           v2: bool = False) -> tuple[DataFrame, DataFrame]:
    """(page, total): ``rows`` is one batch (already pruned by batch_id).

    The page is ``orderBy().offset().limit()``, planned as a distributed
    top-(offset+limit) (TakeOrderedAndProject), never a full sort; the total
    is a separate one-row aggregate over the same pruned scan.
    """
    if not (1 <= limit <= MAX_LIMIT) or offset < 0:
        raise ValueError("limit must be 1..500 and offset >= 0")
    if isinstance(filters, Mapping):
        filters = {k: v for k, v in filters.items() if v is not None}
    filtered = apply_filters(rows, filters)
    cols = [c for c in (LAKE_COLUMNS if v2 else V1_COLUMNS)]
    page = filtered.orderBy(*order_columns(order_by)).select(*cols)
    if offset:
        page = page.offset(offset)
    page = page.limit(limit)
    total = filtered.agg(F.count(F.lit(1)).alias("total"))
    return page, total


def page_with_total(page: DataFrame, total: DataFrame) -> DataFrame:
    """Total as a column of every page row; an empty page gives one row with the total alone."""
    return total.join(F.broadcast(page), F.lit(True), "left").select(*page.columns, *total.columns)


def by_code(lake: DataFrame, code: str) -> DataFrame:
    """One row or none: the newest competence (then newest import) of a code."""
    return (lake.where(F.col("cnes") == F.lit(code))
            .orderBy(F.desc("competencia"), F.desc("imported_at"), F.desc("batch_id"))
            .limit(1))


def by_municipality(rows: DataFrame, name: str, filters: Mapping[str, Any] | None = None,
                    order_by: str = "leitos_existentes", limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Units of a city, largest first; ``filters`` are the other search filters."""
    return search(rows, {**(filters or {}), "municipio": name}, order_by, 0, limit)


def by_uf(rows: DataFrame, uf: str, filters: Mapping[str, Any] | None = None,
          order_by: str = "leitos_existentes", limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Units of a state, largest first; ``filters`` are the other search filters."""
    return search(rows, {**(filters or {}), "uf": uf}, order_by, 0, limit)
