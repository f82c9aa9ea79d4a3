"""Annual single-table source -> canonical v1 rows for one competence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nonneg_int
from ..functions.text import join_label, norm_column_name, norm_text, norm_text_py
from ..functions.rules import bed_range

# Columns the annual file must carry (normalised names).
REQUIRED_COLUMNS = frozenset({"COMP", "UF", "MUNICIPIO", "CNES", "NOME_ESTABELECIMENTO",
                              "TP_GESTAO", "DS_TIPO_UNIDADE", "NATUREZA_JURIDICA",
                              "LEITOS_EXISTENTES", "LEITOS_SUS"})
OPTIONAL_COLUMNS = ("CO_TIPO_UNIDADE", "DESC_NATUREZA_JURIDICA")


@dataclass(frozen=True)
class AnnualRequest:
    competence: str
    uf: str | None = None
    municipality: str | None = None
    establishment_type: str | None = None
    legal_nature: str | None = None
    management: str | None = None
    sus_agreement: bool | None = None
    min_beds: int | None = None
    max_beds: int | None = None

    def local_filters(self) -> tuple[str, ...]:
        """Names of the filters that are set, as the registry's tools call them."""
        named = {"uf": self.uf, "municipio": self.municipality, "tipo_estabelecimento": self.establishment_type,
                 "natureza_juridica": self.legal_nature, "gestao": self.management, "convenio_sus": self.sus_agreement,
                 "min_leitos": self.min_beds, "max_leitos": self.max_beds}
        return ("competencia", *[n for n, v in named.items() if v is not None])


def annual_rows_of(raw: DataFrame) -> DataFrame:
    """The needed columns, trimmed, under their normalised names; optional ones that are missing are empty."""
    cols = {norm_column_name(c): c for c in raw.columns}
    missing = sorted(REQUIRED_COLUMNS - set(cols))
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    return raw.select(*[(F.coalesce(F.trim(F.col(f"`{cols[n]}`")), F.lit("")) if n in cols else F.lit("")).alias(n)
                        for n in (*sorted(REQUIRED_COLUMNS), *OPTIONAL_COLUMNS)])


def canonical_annual(rows: DataFrame, req: AnnualRequest) -> DataFrame:
    """Canonical columns of the rows that match by text, with ``_ok`` (bed counts are readable) and ``_kept``
    (and fit the flag and bed range). Accent-insensitive ``contains`` on every text filter."""
    cond = F.col("COMP") == F.lit(req.competence)
    if req.uf:
        cond = cond & (F.upper("UF") == F.lit(req.uf.upper()))
    nature = join_label(F.col("NATUREZA_JURIDICA"), F.col("DESC_NATUREZA_JURIDICA"))
    for value, col in ((req.municipality, F.col("MUNICIPIO")), (req.establishment_type, F.col("DS_TIPO_UNIDADE")),
                       (req.legal_nature, nature), (req.management, F.col("TP_GESTAO"))):
        if value:
            cond = cond & F.contains(norm_text(col), F.lit(norm_text_py(value)))
    beds, beds_ok = nonneg_int(F.col("LEITOS_EXISTENTES"))
    sus, sus_ok = nonneg_int(F.col("LEITOS_SUS"))
    fits = bed_range("LEITOS_EXISTENTES", req.min_beds, req.max_beds)
    if req.sus_agreement is not None:
        fits = fits & ((F.col("LEITOS_SUS") > 0) == F.lit(req.sus_agreement))
    out = rows.where(cond).select(
        (beds_ok & sus_ok).alias("_ok"), F.lit(req.competence).alias("COMPETENCIA"), "UF", "MUNICIPIO", "CNES",
        F.col("NOME_ESTABELECIMENTO").alias("NOME_FANTASIA"),
        join_label(F.col("CO_TIPO_UNIDADE"), F.col("DS_TIPO_UNIDADE")).alias("TIPO_ESTABELECIMENTO"),
        nature.alias("NATUREZA_JURIDICA"), F.col("TP_GESTAO").alias("GESTAO"),
        F.when(sus > 0, F.lit("Sim")).otherwise(F.lit("Não")).alias("CONVENIO_SUS"),
        beds.alias("LEITOS_EXISTENTES"), sus.alias("LEITOS_SUS"))
    return out.withColumn("_kept", F.col("_ok") & F.coalesce(fits, F.lit(False)))


def normalize_annual(raw: DataFrame, req: AnnualRequest) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, rejected count). Matching rows with unparsable beds are counted, not fatal."""
    matched = canonical_annual(annual_rows_of(raw), req)
    return matched.where("_kept").drop("_ok", "_kept"), matched.agg(F.count_if(~F.col("_ok")).alias("rejeitadas"))
