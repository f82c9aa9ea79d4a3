"""Weighted lead score over four dimensions (exact whole-batch ranks)."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import append_flags, array_has
from ..session import materialize
from .filters import apply_filters
from .ranking import join_ranks, value_ranks

# Columns that the scores and their output read.
SCORED = ("cnes", "nome_fantasia", "razao_social", "cnpj", "cnpj_mantenedora", "municipio", "uf",
          "tipo_estabelecimento", "leitos_existentes", "leitos_sus", "leitos_uti",
          "total_habilitacoes", "delta_leitos", "campos_ausentes")
WEIGHT_NAMES = ("porte", "complexidade", "mix_pagador", "tendencia")


def check_weights(weights: Mapping[str, float]) -> dict[str, float]:
    if set(weights) != set(WEIGHT_NAMES):
        raise ValueError(f"weights must name exactly {WEIGHT_NAMES}")
    w = {k: float(v) for k, v in weights.items()}
    if any(v < 0 for v in w.values()) or sum(w.values()) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    return w


def score_leads(current: DataFrame, prior: DataFrame, weights: Mapping[str, float],
                filters: Mapping[str, Any] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Scores for every filtered row of ``current``; the caller orders
    ``score_total DESC NULLS LAST, cnes`` and limits.

    ``keys`` (e.g. ``("competencia",)``) scores many periods in one plan:
    ranks and maxima are per key, and ``prior`` must carry the key of the
    period it is the prior of.
    """
    w = check_weights(weights)
    keys = tuple(keys)
    cur = apply_filters(current, filters)
    p = prior.select(*keys, "cnes", F.col("leitos_existentes").alias("_p_beds"),
                     F.col("campos_ausentes").alias("_p_abs"), F.lit(True).alias("_p_in"))
    raw = cur.join(p, [*keys, "cnes"], "left")
    uti = F.when(F.col("leitos_uti_adulto").isNotNull() & F.col("leitos_uti_pediatrica").isNotNull()
                 & F.col("leitos_uti_neonatal").isNotNull(),
                 F.col("leitos_uti_adulto") + F.col("leitos_uti_pediatrica")
                 + F.col("leitos_uti_neonatal"))
    delta = (F.when(array_has("campos_ausentes", "leitos_existentes"), F.lit(None))
             .when(F.col("_p_in").isNotNull() & array_has("_p_abs", "leitos_existentes"), F.lit(None))
             .otherwise(F.col("leitos_existentes") - F.coalesce("_p_beds", F.lit(0))))
    raw = raw.withColumn("leitos_uti", uti).withColumn("delta_leitos", delta.cast("bigint"))
    # Written once: the histograms and the scored rows both read the file.
    raw = materialize(raw.select(
        *keys, *[c for c in SCORED if c not in keys]), "lead-rows")
    specs = [("leitos_existentes", "cume_dist", "_cd_beds"),
             ("leitos_uti", "percent_rank", "_pr_uti"),
             ("total_habilitacoes", "percent_rank", "_pr_hab"),
             ("delta_leitos", "cume_dist", "_cd_delta")]
    ranks = materialize(value_ranks(raw, [value for value, _, _ in specs], keys), "lead-ranks")
    raw = join_ranks(raw, ranks, specs, keys)
    maxes = ranks.groupBy(*keys).agg(F.max(F.when(F.col("_spec") == 1, F.col("_v"))).alias("_max_uti"),
                                     F.max(F.when(F.col("_spec") == 2, F.col("_v"))).alias("_max_hab"))
    # One row per key (per period): bounded by the calendar.
    s = raw.join(F.broadcast(maxes), list(keys)) if keys else raw.crossJoin(F.broadcast(maxes))
    porte = F.when(~array_has("campos_ausentes", "leitos_existentes"), F.lit(100) * F.col("_cd_beds"))
    c_uti = (F.when(F.col("leitos_uti").isNull(), F.lit(None))
             .when(F.col("_max_uti") == 0, F.lit(0.0))
             .otherwise(F.lit(100) * F.col("_pr_uti")))
    c_hab = F.when(F.col("_max_hab") == 0, F.lit(0.0)).otherwise(F.lit(100) * F.col("_pr_hab"))
    beds, sus = F.col("leitos_existentes"), F.col("leitos_sus")
    mix = F.when((beds > 0) & sus.between(F.lit(0), beds)
                 & ~array_has("campos_ausentes", "leitos_sus"),
                 F.lit(100) * (F.lit(1) - F.least(sus, beds) / beds.cast("double")))
    trend = F.when(F.col("delta_leitos").isNotNull(), F.lit(100) * F.col("_cd_delta"))
    s = s.select("*", porte.alias("score_porte"), c_uti.alias("score_complexidade_uti"),
                 c_hab.alias("score_complexidade_habilitacoes"),
                 mix.alias("score_mix_pagador"), trend.alias("score_tendencia"))
    s = s.withColumn("score_complexidade", F.when(
        F.col("score_complexidade_uti").isNull(), F.col("score_complexidade_habilitacoes"))
        .otherwise((F.col("score_complexidade_uti") + F.col("score_complexidade_habilitacoes")) / 2))
    order = (("score_porte", w["porte"]), ("score_complexidade", w["complexidade"]),
             ("score_tendencia", w["tendencia"]), ("score_mix_pagador", w["mix_pagador"]))
    den = None
    num = None
    for col, weight in order:
        d = F.when(F.col(col).isNull(), F.lit(0.0)).otherwise(F.lit(weight))
        n = F.coalesce(F.col(col) * F.lit(weight), F.lit(0.0))
        den = d if den is None else den + d
        num = n if num is None else num + n
    s = s.withColumn("score_total", F.when(den > 0, num / den))
    absent = append_flags("campos_ausentes", [
        (F.col("score_porte").isNull(), ["score_porte"]),
        (F.col("score_complexidade_uti").isNull(), ["score_complexidade_uti"]),
        (F.col("score_mix_pagador").isNull(), ["score_mix_pagador"]),
        (F.col("score_tendencia").isNull(), ["score_tendencia"]),
    ])
    return s.select(
        *keys, "cnes", "nome_fantasia", "razao_social", "cnpj", "cnpj_mantenedora", "municipio", "uf",
        "tipo_estabelecimento", "leitos_existentes", "leitos_sus", "leitos_uti",
        "total_habilitacoes", "delta_leitos",
        *[F.round(c, 4).alias(c) for c in (
            "score_porte", "score_complexidade_uti", "score_complexidade_habilitacoes",
            "score_complexidade", "score_mix_pagador", "score_tendencia", "score_total")],
        absent.alias("campos_ausentes"))


def top_leads(scored: DataFrame, limit: int) -> DataFrame:
    return scored.orderBy(F.desc_nulls_last("score_total"), F.asc("cnes")).limit(limit)
