"""Dataset validation, per batch, in one pass over units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import array_has

# Text fields whose blanks are counted.
TEXT_FIELDS = ("cnes", "nome_fantasia", "municipio", "uf", "tipo_estabelecimento",
               "natureza_juridica", "gestao", "competencia")


def _blank(c: str):
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def validate(lake: DataFrame, keys: Sequence[str] = ("batch_id",), rollup: str | None = None) -> DataFrame:
    """Counts of doubtful rows and the verdict, per ``keys``; with ``rollup`` also one row over
    all of the lake, named so in the key columns.

    Rows are counted per code and competence first (for the roll-up as a second grouping set of
    the same pass), so duplicates need no other pass, and a hot batch is summed from its units.
    """
    keys, unit = list(keys), ["cnes", "competencia"]
    sets = [[*keys, *unit], unit] if rollup is not None else [[*keys, *unit]]
    flags = {f"vazios_{c}": _blank(c) for c in TEXT_FIELDS} | {
        "leitos_invalidos": (F.col("leitos_existentes") < 0) | (F.col("leitos_sus") < 0)
        | (F.col("leitos_sus") > F.col("leitos_existentes")),
        "leitos_ausentes": array_has("campos_ausentes", "leitos_existentes") | array_has("campos_ausentes", "leitos_sus")}
    rows = lake.select(*[F.col(k) for k in [*keys, *unit]], *[c.cast("int").alias(n) for n, c in flags.items()])
    counted = rows.groupingSets(sets, *keys, *unit).agg(
        F.count(F.lit(1)).alias("_n"), F.grouping(keys[0]).alias("_all"), *[F.sum(n).alias(n) for n in flags])
    named = [F.when(F.col("_all") == 1, F.lit(rollup)).otherwise(F.col(k)).alias(k) for k in keys]
    out = counted.select(*named, "_n", "competencia", *flags).groupBy(*keys).agg(
        F.sum("_n").alias("total_registros"), *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in flags],
        F.sum(F.col("_n") - 1).cast("bigint").alias("cnes_duplicados"),
        # Distinct months per batch: bounded by the calendar, deduped map-side.
        F.array_sort(F.collect_set(F.when(~_blank("competencia"), F.col("competencia")))).alias("_comps"))
    return out.select(
        *keys, "total_registros", *[f"vazios_{c}" for c in TEXT_FIELDS], "cnes_duplicados",
        F.array_join("_comps", ",").alias("competencias"),
        (F.size("_comps") > 1).alias("competencias_mistas"),
        "leitos_invalidos", "leitos_ausentes",
        ((F.col("total_registros") > 0) & (F.col("cnes_duplicados") == 0)
         & (F.col("leitos_invalidos") == 0) & (F.col("leitos_ausentes") == 0)).alias("valido"),
    )
