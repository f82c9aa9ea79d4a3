"""Conjunctive search filters -> one Column (pushed to the Parquet scan).

Argument checks run on the driver before a plan is built; the filter
itself is a single predicate that Catalyst pushes below projections.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_text_py

MAX_CODES = 500
FILTER_KEYS = frozenset({"uf", "gestao", "convenio_sus", "municipio", "tipo_estabelecimento",
                         "natureza_juridica", "min_leitos", "max_leitos", "cnes_list"})


@dataclass(frozen=True)
class Filters:
    uf: str | None = None
    gestao: str | None = None
    convenio_sus: bool | None = None
    municipio: str | None = None
    tipo_estabelecimento: str | None = None
    natureza_juridica: str | None = None
    min_leitos: int | None = None
    max_leitos: int | None = None
    cnes_list: Sequence[str] = field(default_factory=tuple)

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any] | None) -> "Filters":
        values = dict(values or {})
        unknown = set(values) - FILTER_KEYS
        if unknown:
            raise ValueError(f"unknown filter keys: {sorted(unknown)}")
        f = cls(**{k: (tuple(v) if k == "cnes_list" else v) for k, v in values.items()})
        f.validate()
        return f

    def validate(self) -> None:
        if self.uf is not None and not re.fullmatch(r"[A-Za-z]{2}", str(self.uf)):
            raise ValueError("uf must have two letters")
        if self.convenio_sus is not None and not isinstance(self.convenio_sus, bool):
            raise ValueError("convenio_sus must be boolean")
        for label, v in (("min_leitos", self.min_leitos), ("max_leitos", self.max_leitos)):
            if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 0):
                raise ValueError(f"{label} must be a non-negative integer")
        if (self.min_leitos is not None and self.max_leitos is not None
                and self.min_leitos > self.max_leitos):
            raise ValueError("min_leitos greater than max_leitos")
        if self.cnes_list:
            if len(self.cnes_list) > MAX_CODES:
                raise ValueError(f"at most {MAX_CODES} codes")
            bad = [c for c in self.cnes_list if not re.fullmatch(r"[0-9]{7}", str(c))]
            if bad:
                raise ValueError(f"codes must have 7 digits: {bad[:3]}")


def unit_predicate(f: Filters) -> Column:
    """What an establishment's own columns decide: exact state and management,
    partial city, type and legal nature (case-insensitive), code list."""
    cond = F.lit(True)
    if f.uf is not None:
        cond = cond & (F.col("uf") == F.lit(str(f.uf).upper()))
    if f.gestao is not None:
        cond = cond & (F.col("gestao") == F.lit(str(f.gestao).upper()))
    if f.municipio:
        cond = cond & F.contains(F.lower("municipio_normalizado"),
                                 F.lit(norm_text_py(f.municipio).lower()))
    if f.tipo_estabelecimento:
        cond = cond & F.contains(F.lower("tipo_estabelecimento"),
                                 F.lit(f.tipo_estabelecimento.lower()))
    if f.natureza_juridica:
        cond = cond & F.contains(F.lower("natureza_juridica"),
                                 F.lit(f.natureza_juridica.lower()))
    if f.cnes_list:  # at most MAX_CODES; Spark turns a long IN into one hash set
        cond = cond & F.col("cnes").isin([str(c) for c in f.cnes_list])
    return cond


def bed_predicate(f: Filters) -> Column:
    """What the bed totals decide: agreement flag and inclusive bed range."""
    cond = F.lit(True)
    if f.convenio_sus is not None:
        cond = cond & (F.col("convenio_sus") == F.lit(bool(f.convenio_sus)))
    if f.min_leitos is not None:
        cond = cond & (F.col("leitos_existentes") >= F.lit(int(f.min_leitos)))
    if f.max_leitos is not None:
        cond = cond & (F.col("leitos_existentes") <= F.lit(int(f.max_leitos)))
    return cond


def predicate(f: Filters) -> Column:
    return unit_predicate(f) & bed_predicate(f)


def as_filters(filters: Filters | Mapping[str, Any] | None) -> Filters:
    return filters if isinstance(filters, Filters) else Filters.from_mapping(filters)


def filters_json(filters: Filters | Mapping[str, Any] | None) -> str:
    """The filters that are set, as sorted JSON in canonical form: the catalog's record and part of a batch's identity."""
    f = as_filters(filters)
    values = {k: v for k, v in asdict(f).items() if v is not None and v != () and v != ""}
    for k in ("uf", "gestao"):
        if k in values:
            values[k] = str(values[k]).upper()
    if "cnes_list" in values:
        values["cnes_list"] = sorted(set(map(str, values["cnes_list"])))
    return json.dumps(values, sort_keys=True, ensure_ascii=False)


def apply_filters(df: DataFrame, filters: Filters | Mapping[str, Any] | None) -> DataFrame:
    return df.where(predicate(as_filters(filters)))


def for_batch(lake: DataFrame, batch_id: str | None) -> DataFrame:
    """Batch selection = partition pruning on ``batch_id``."""
    return lake if batch_id is None else lake.where(F.col("batch_id") == F.lit(batch_id))


def match_collector(rows: DataFrame, municipality: str | None, min_beds: int | None,
                    max_beds: int | None, nature_codes) -> DataFrame:
    """Collector rule: accent-insensitive municipality contains, inclusive bed
    range, legal nature starting with one of the (private) codes."""
    from ..functions.rules import bed_range, prefix_any
    from ..functions.text import norm_text
    cond = bed_range("leitos_existentes", min_beds, max_beds) & prefix_any("natureza_juridica", nature_codes)
    if municipality:
        cond = cond & F.contains(norm_text("municipio"), F.lit(norm_text_py(municipality)))
    return rows.where(cond)
