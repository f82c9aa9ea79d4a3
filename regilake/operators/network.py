"""Maintainer (ownership network) rollup."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio_round
from .aggregate import flag_poisoned_sum
from .filters import apply_filters

MAX_GROUPS = 500


def _has_maintainer():
    return F.coalesce(F.trim("cnpj_mantenedora"), F.lit("")) != ""


def maintainer_groups(rows: DataFrame, filters: Mapping[str, Any] | None = None,
                      limit: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, uf_distribution, without_maintainer) for one batch.

    Groups: top ``limit`` maintainers by units desc, beds desc (NULLs last),
    id; bed sums are NULL when any member lists them as absent. The top-N
    (<= 500 rows, checked) is broadcast back to the member rows for the
    per-state distribution.
    """
    if not 1 <= limit <= MAX_GROUPS:
        raise ValueError("limit must be 1..500")
    filtered = apply_filters(rows, filters)
    missing = filtered.where(~_has_maintainer()).agg(
        F.count(F.lit(1)).alias("unidades_sem_cnpj_mantenedora"))
    with_m = filtered.where(_has_maintainer())
    ranked = (with_m.groupBy("cnpj_mantenedora").agg(
        F.count(F.lit(1)).alias("unidades"),
        flag_poisoned_sum("leitos_existentes").cast("bigint").alias("leitos_existentes"),
        flag_poisoned_sum("leitos_sus").cast("bigint").alias("leitos_sus"))
        .orderBy(F.desc("unidades"), F.desc_nulls_last("leitos_existentes"),
                 F.asc("cnpj_mantenedora"))
        .limit(limit))
    beds, sus = F.col("leitos_existentes"), F.col("leitos_sus")
    mix = ratio_round(sus, beds)
    groups = ranked.select(
        "cnpj_mantenedora", "unidades", "leitos_existentes", "leitos_sus",
        mix.alias("mix_sus"),
        F.round(F.lit(1.0) - mix, 6).alias("mix_nao_sus"),
        F.when(beds.isNotNull() & sus.isNotNull() & (sus > beds),
               F.lit("leitos_sus_maior_que_leitos_existentes")).alias("alerta"),
        F.concat_ws(",", F.lit("nome_mantenedora"),
                    F.when(beds.isNull(), F.lit("leitos_existentes")),
                    F.when(sus.isNull(), F.lit("leitos_sus"))).alias("campos_ausentes"),
    )
    dist = (with_m.join(F.broadcast(ranked.select("cnpj_mantenedora")), "cnpj_mantenedora")
            .groupBy("cnpj_mantenedora", "uf").agg(F.count(F.lit(1)).alias("unidades_uf")))
    return groups, dist, missing
