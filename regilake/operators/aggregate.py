"""Grouped aggregates, statistics and small per-group summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import array_has

# Aggregate dimensions and metrics offered to users.
GROUPS = {"uf": "uf", "municipio": "municipio", "tipo": "tipo_estabelecimento",
          "natureza": "natureza_juridica", "gestao": "gestao"}
METRICS = ("estabelecimentos", "leitos_existentes", "leitos_sus", "media_leitos")


def _metric(name: str) -> Column:
    if name == "estabelecimentos":
        return F.count(F.lit(1))
    if name == "leitos_existentes":
        return F.sum("leitos_existentes")
    if name == "leitos_sus":
        return F.sum("leitos_sus")
    if name == "media_leitos":
        return F.avg("leitos_existentes")
    raise ValueError(f"unsupported metric {name}")


def aggregate_by(df: DataFrame, group_by: str, metric: str,
                 keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """``grupo``/``valor`` per group (and per batch), ordered value desc, group.

    Partial + final hash aggregation; the shuffle carries one row per group
    per map task. ``keys`` keeps the history-wide variant one plan.
    """
    if group_by not in GROUPS or metric not in METRICS:
        raise ValueError("unsupported group_by or metric")
    keys = [k for k in keys if k in df.columns]
    out = df.groupBy(*keys, F.col(GROUPS[group_by]).alias("grupo")).agg(_metric(metric).alias("valor"))
    return out.orderBy(*keys, F.desc("valor"), F.asc("grupo"))


def statistics(df: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    keys = [k for k in keys if k in df.columns]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_estabelecimentos"),
        F.coalesce(F.sum("leitos_existentes"), F.lit(0)).cast("bigint").alias("total_leitos_existentes"),
        F.coalesce(F.sum("leitos_sus"), F.lit(0)).cast("bigint").alias("total_leitos_sus"))


def statistics_by_uf(df: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    keys = [k for k in keys if k in df.columns]
    return df.groupBy(*keys, "uf").agg(F.count(F.lit(1)).alias("estabelecimentos")).orderBy(*keys, "uf")


def flag_poisoned_sum(value: str, absent_col: str = "campos_ausentes") -> Column:
    """SUM that is NULL when any row lists ``value`` as absent."""
    return F.when(F.count_if(array_has(absent_col, value)) == 0, F.sum(value))


def union_absent(df: DataFrame, col: str = "campos_ausentes",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Sorted union of absent-field names.

    Exploded and de-duplicated before collecting, so a group never holds
    more than the (fixed) number of field names.
    """
    names = df.select(*keys, F.explode_outer(col).alias("_n")).where(F.col("_n").isNotNull())
    names = names.distinct()
    return names.groupBy(*keys).agg(F.array_sort(F.collect_list("_n")).alias(col))


def missing_profile(df: DataFrame, columns: Sequence[str],
                    keys: Sequence[str] = ()) -> DataFrame:
    """Fields empty in every row (only for groups with >= 1 row), one pass."""
    filled = [F.max((F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").cast("int"))
              .alias(c) for c in columns]
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *filled)
    empty = F.filter(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in columns]),
                     lambda x: x.isNotNull())
    return agg.select(*keys, F.col("_rows").alias("linhas"), empty.alias("campos_vazios"))


def uf_distribution(df: DataFrame, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """Long form rows (group, uf, units) -- the map form is ``as_map``."""
    return df.groupBy(*keys, group, "uf").agg(F.count(F.lit(1)).alias("unidades_uf"))


def as_map(long_df: DataFrame, group: str, key: str, value: str,
           keys: Sequence[str] = ()) -> DataFrame:
    """Long rows -> sorted map per group (one entry per state: bounded)."""
    return long_df.groupBy(*keys, group).agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))).alias("distribuicao"))
