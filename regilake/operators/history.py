"""Multi-batch operators: latest version, time series, diff, triggers.

Batch and competence are columns of one lake, so every operator is one
plan over a partition-pruned scan; the per-pair variants are filters of
the history-wide ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import array_has
from ..functions.text import norm_text_py


def latest_version(lake: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Per (cnes, competencia, ``within``) keep the newest import (imported_at, then batch_id)."""
    w = Window.partitionBy("cnes", "competencia", *[c for c in within if c != "cnes"]).orderBy(F.desc("imported_at"), F.desc("batch_id"))
    return lake.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def timeseries(lake: DataFrame, key: str | None, key_type: str, start: str, end: str) -> DataFrame:
    """Counts and bed sums per competence for one code / municipality.

    ``key=None`` returns the series of every key at once (grouped by it).
    """
    if key_type not in ("cnes", "municipio"):
        raise ValueError("key_type must be cnes or municipio")
    column = "cnes" if key_type == "cnes" else "municipio_normalizado"
    rows = lake.where(F.col("competencia").between(start, end))
    if key is not None:
        value = key if key_type == "cnes" else norm_text_py(key)
        rows = rows.where(F.col(column) == F.lit(value))
    # Of a key's own rows, so that a unit that moved counts alike with and without a key.
    rows = latest_version(rows, [column])
    keys = [] if key is not None else [F.col(column).alias("chave")]
    return rows.groupBy(*keys, "competencia").agg(
        F.count(F.lit(1)).alias("estabelecimentos"),
        F.sum("leitos_existentes").cast("bigint").alias("leitos_existentes"),
        F.sum("leitos_sus").cast("bigint").alias("leitos_sus")) \
        .orderBy(*([] if key is not None else ["chave"]), "competencia")


def _mixed_flag(rows: DataFrame) -> DataFrame:
    return rows.agg((F.count_distinct("competencia") > 1).alias("_mixed"))


def diff(lake: DataFrame, batch_a: str, batch_b: str) -> DataFrame:
    """Full outer compare of two batches on code (code@competence when
    either batch holds more than one competence).

    One row per entered / left / changed key: ``status`` in
    {entrou, saiu, mudou}.
    """
    a = lake.where(F.col("batch_id") == batch_a)
    b = lake.where(F.col("batch_id") == batch_b)
    flags = _mixed_flag(a).crossJoin(_mixed_flag(b).withColumnRenamed("_mixed", "_mb"))
    mixed = flags.select((F.col("_mixed") | F.col("_mb")).alias("mixed"))

    def side(df: DataFrame, tag: str) -> DataFrame:
        d = df.crossJoin(F.broadcast(mixed))
        return d.select(
            "cnes", F.when(F.col("mixed"), F.col("competencia")).otherwise(F.lit("")).alias("_k"),
            F.col("competencia").alias(f"competencia_{tag}"),
            F.col("leitos_existentes").alias(f"leitos_existentes_{tag}"),
            F.col("leitos_sus").alias(f"leitos_sus_{tag}"), "mixed")

    j = side(a, "a").drop("mixed").join(side(b, "b"), ["cnes", "_k"], "full")
    status = (F.when(F.col("competencia_a").isNull(), F.lit("entrou"))
              .when(F.col("competencia_b").isNull(), F.lit("saiu"))
              .when((F.col("leitos_existentes_a") != F.col("leitos_existentes_b"))
                    | (F.col("leitos_sus_a") != F.col("leitos_sus_b")), F.lit("mudou")))
    key = F.when(F.col("_k") != "", F.concat_ws("@", "cnes", "_k")).otherwise(F.col("cnes"))
    return j.select(key.alias("chave"), "cnes", status.alias("status"),
                    "competencia_a", "competencia_b", "leitos_existentes_a",
                    "leitos_existentes_b", "leitos_sus_a", "leitos_sus_b").where(
        F.col("status").isNotNull())


def _compare_base(a: DataFrame, b: DataFrame, join_keys: Sequence[str]) -> DataFrame:
    cols = ["cnes", "nome_fantasia", "tipo_estabelecimento", "leitos_existentes",
            "leitos_sus", "campos_ausentes"]
    extra = [k for k in join_keys if k != "cnes"]
    aa = a.select(*extra, *[F.col(c).alias(f"{c}_a") if c != "cnes" else F.col(c) for c in cols],
                  F.lit(True).alias("_in_a"))
    bb = b.select(*extra, *[F.col(c).alias(f"{c}_b") if c != "cnes" else F.col(c) for c in cols],
                  F.lit(True).alias("_in_b"))
    return aa.join(bb, list(join_keys), "full")


def _triggers(j: DataFrame, delta_min: int, establishment_type: str | None,
              keep: Sequence[str] = ()) -> DataFrame:
    tipo = F.coalesce("tipo_estabelecimento_b", "tipo_estabelecimento_a")
    if establishment_type:
        j = j.where(F.contains(F.lower(tipo), F.lit(establishment_type.lower())))
    absent = ((F.col("_in_a").isNotNull() & array_has("campos_ausentes_a", "leitos_existentes"))
              | (F.col("_in_b").isNotNull() & array_has("campos_ausentes_b", "leitos_existentes")))
    delta = F.coalesce("leitos_existentes_b", F.lit(0)) - F.coalesce("leitos_existentes_a", F.lit(0))
    motivo = (F.when(F.col("leitos_existentes_a").isNull(), F.lit("entrada"))
              .when(F.col("leitos_existentes_b").isNull(), F.lit("saida"))
              .when(F.col("leitos_existentes_b") > F.col("leitos_existentes_a"), F.lit("expansao"))
              .when(F.col("leitos_existentes_b") < F.col("leitos_existentes_a"), F.lit("retracao")))
    return j.select(
        *keep, "cnes",
        F.coalesce("nome_fantasia_b", "nome_fantasia_a").alias("nome_fantasia"),
        tipo.alias("tipo_estabelecimento"),
        "leitos_existentes_a", "leitos_existentes_b", "leitos_sus_a", "leitos_sus_b",
        absent.alias("leitos_ausentes"),
        F.when(~absent, delta).alias("delta_leitos"),
        F.when(~absent, motivo).alias("motivo"),
    ).where(F.col("leitos_ausentes")
            | (F.col("motivo").isNotNull() & (F.abs("delta_leitos") >= F.lit(delta_min))))


def lead_triggers(lake: DataFrame, batch_a: str, batch_b: str, delta_min: int,
                  establishment_type: str | None = None) -> DataFrame:
    """Entry / exit / expansion / retraction between two batches.

    Rows with absent beds in either side are returned with
    ``leitos_ausentes = true`` and no motive (the omitted-count warning).
    """
    if delta_min < 0:
        raise ValueError("delta_min must be >= 0")
    a = lake.where(F.col("batch_id") == batch_a)
    b = lake.where(F.col("batch_id") == batch_b)
    out = _triggers(_compare_base(a, b, ["cnes"]), delta_min, establishment_type)
    return out.orderBy(F.desc_nulls_last(F.abs("delta_leitos")), "cnes")


def consecutive_pairs(lake: DataFrame) -> DataFrame:
    """(competencia_a, competencia_b) of consecutive competences.

    Built from the distinct competences (at most 12 per year by pattern),
    so the window here sees a calendar-sized input, not the data.
    """
    comps = lake.select("competencia").distinct()
    w = Window.orderBy("competencia")
    return comps.select(F.col("competencia").alias("competencia_a"),
                        F.lead("competencia").over(w).alias("competencia_b")) \
                .where(F.col("competencia_b").isNotNull())


def lead_triggers_history(lake: DataFrame, delta_min: int,
                          establishment_type: str | None = None) -> DataFrame:
    """Triggers for every pair of consecutive competences in one plan.

    ``lake`` must hold one batch per competence (e.g. ``latest_version``).
    Each side is tagged with its pair id through the calendar-sized pair
    list, then one full outer join on (pair, code).
    """
    pairs = consecutive_pairs(lake)
    a = lake.join(pairs.select(F.col("competencia_a").alias("competencia"),
                               F.col("competencia_b").alias("_pair")), "competencia")
    b = lake.join(pairs.select(F.col("competencia_b").alias("competencia")), "competencia") \
            .withColumn("_pair", F.col("competencia"))
    j = _compare_base(a, b, ["_pair", "cnes"])
    out = _triggers(j, delta_min, establishment_type, keep=["_pair"])
    return out.withColumnRenamed("_pair", "competencia_b")
