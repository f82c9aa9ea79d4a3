"""Normalise raw files to the canonical 11-column CSV (no batch)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import csv_files as CF
from ..sources.annual import AnnualRequest, annual_rows_of, canonical_annual
from ..sources.archives import read_annual
from .export import normalized_csv
from .load import plan_csv_load

TEXT_FIELDS = ("cnes", "nome_fantasia", "municipio", "uf", "tipo_estabelecimento",
               "natureza_juridica", "gestao", "competencia")
DERIVABLE = ("convenio_sus", "leitos_existentes", "leitos_sus")


class NothingFound(ValueError):
    pass


def observed(rows: DataFrame, metrics: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``rows`` with metrics that are taken while an action runs over them."""
    taken = Observation()
    return rows.observe(taken, *[c.alias(n) for n, c in metrics.items()]), taken


def normalize_csv(spark: SparkSession, paths: Sequence[str], dest: str) -> dict[str, Any]:
    """Consolidated canonical CSV + fields empty in every row + fields the
    files did not carry (derived: SUS flag from SUS beds, zero beds).

    The files are read and consolidated once: the counts are observed while
    the rows are written.
    """
    plan = plan_csv_load(spark, paths)
    filled = {c: F.max(F.when(F.coalesce(F.trim(c), F.lit("")) != "", 1).otherwise(0)) for c in TEXT_FIELDS}
    rows, taken = observed(plan.consolidated, {"linhas": F.count(F.lit(1)), **filled})
    normalized_csv(rows, dest)
    found = taken.get
    return {"path": dest, "registros": found["linhas"],
            "campos_vazios": [c for c in TEXT_FIELDS if found["linhas"] and not found[c]],
            "campos_derivados": sorted(plan.missing.intersection(DERIVABLE))}


def read_annual_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Annual files (CSV, or ZIPs of one CSV each) as strings under normalised column names."""
    zips = [p for p in paths if p.lower().endswith(".zip")]
    plain = [p for p in paths if p not in zips]
    parts = [read_annual(spark, [z]) for z in zips] + ([df.drop("_ord", CF.CORRUPT) for _, df in CF.read_raw(spark, plain, ";")] if plain else [])
    out = annual_rows_of(parts[0])
    for p in parts[1:]:
        out = out.unionByName(annual_rows_of(p))
    return out


def normalize_annual_files(spark: SparkSession, paths: Sequence[str], request: AnnualRequest, dest: str) -> dict[str, Any]:
    """The canonical CSV of one competence and its filters, from annual files read once.

    Matching rows whose bed counts cannot be read are counted as rejected. If
    no row is left, nothing appears at ``dest`` and NothingFound is raised:
    the rows go to a folder beside it first, which is renamed at the end.
    """
    matched = canonical_annual(read_annual_files(spark, paths), request)
    rows, taken = observed(matched, {"rejeitadas": F.count_if(~F.col("_ok")), "registros": F.count_if(F.col("_kept"))})
    staging = f"{dest.rstrip('/')}.part"
    kept = rows.where("_kept").drop("_ok", "_kept")
    kept.write.mode("overwrite").option("header", True).csv(staging)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(dest).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = taken.get
    if not found["registros"]:
        fs.delete(path(staging), True)
        raise NothingFound(f"no rows for competence {request.competence} and the filters {list(request.local_filters())}")
    fs.delete(path(dest), True)
    if not fs.rename(path(staging), path(dest)):
        raise OSError(f"{staging} could not be renamed to {dest}")
    return {"path": dest, **found, "filtros_locais": list(request.local_filters()), "campos_derivados": ["convenio_sus"]}
