"""Column contracts of the registry lake (v1, v2 and storage row)."""

from __future__ import annotations

from pyspark.sql import types as T

# Contract column names (must equal the source data contract).
V1_COLUMNS = (
    "competencia", "uf", "municipio", "cnes", "nome_fantasia",
    "tipo_estabelecimento", "natureza_juridica", "gestao",
    "leitos_existentes", "leitos_sus", "convenio_sus",
)
V2_COLUMNS = (
    "razao_social", "cnpj", "cnpj_mantenedora", "tipo_pessoa", "nivel_dependencia",
    "logradouro", "numero", "complemento", "bairro", "cep", "latitude", "longitude",
    "geo_confiavel", "telefone", "email", "leitos_uti_adulto", "leitos_uti_pediatrica",
    "leitos_uti_neonatal", "leitos_cirurgicos", "leitos_clinicos", "leitos_obstetricos",
    "leitos_complementares", "habilitacoes", "total_habilitacoes", "campos_ausentes",
)
# Names recorded in campos_ausentes when the bed total / SUS total is unknown.
ABSENT_WHEN_NO_BEDS = (
    "leitos_existentes", "leitos_uti_adulto", "leitos_uti_pediatrica",
    "leitos_uti_neonatal", "leitos_cirurgicos", "leitos_clinicos",
    "leitos_obstetricos", "leitos_complementares",
)
ABSENT_WHEN_NO_SUS = ("leitos_sus", "convenio_sus")
# Export column headers of the canonical CSV (v1 projection).
EXPORT_HEADERS = {
    "COMPETENCIA": "competencia", "UF": "uf", "MUNICIPIO": "municipio", "CNES": "cnes",
    "NOME_FANTASIA": "nome_fantasia", "TIPO_ESTABELECIMENTO": "tipo_estabelecimento",
    "NATUREZA_JURIDICA": "natureza_juridica", "GESTAO": "gestao",
    "CONVENIO_SUS": "convenio_sus", "LEITOS_EXISTENTES": "leitos_existentes",
    "LEITOS_SUS": "leitos_sus",
}
CRM_COLUMNS = (
    "chave_deduplicacao", "cnes", "cnpj", "cnpj_mantenedora", "razao_social",
    "nome_fantasia", "tipo_estabelecimento", "natureza_juridica", "gestao", "municipio",
    "uf", "logradouro", "numero", "complemento", "bairro", "cep", "telefone", "email",
    "leitos_existentes", "leitos_sus", "leitos_uti_adulto", "leitos_uti_pediatrica",
    "leitos_uti_neonatal", "leitos_cirurgicos", "leitos_clinicos", "leitos_obstetricos",
    "leitos_complementares", "habilitacoes", "total_habilitacoes", "campos_ausentes",
    "competencia",
)

_STR, _LONG, _DBL, _BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_ARR = T.ArrayType(T.StringType())

V1_SCHEMA = T.StructType([
    T.StructField(name, _LONG if name.startswith("leitos") else
                  _BOOL if name == "convenio_sus" else _STR, False)
    for name in V1_COLUMNS
])

_V2_TYPES = {
    "latitude": _DBL, "longitude": _DBL, "geo_confiavel": _BOOL,
    "habilitacoes": _ARR, "campos_ausentes": _ARR, "total_habilitacoes": _LONG,
}

LAKE_SCHEMA = T.StructType(
    list(V1_SCHEMA.fields)
    + [T.StructField(n, _V2_TYPES.get(n, _LONG if n.startswith("leitos") else _STR), True)
       for n in V2_COLUMNS]
    + [T.StructField("municipio_normalizado", _STR, True)]
)
LAKE_COLUMNS = tuple(f.name for f in LAKE_SCHEMA.fields)

# One row per batch in the catalog table.
CATALOG_SCHEMA = T.StructType([
    T.StructField("batch_id", _STR, False),
    T.StructField("source_file", _STR, True),
    T.StructField("source", _STR, True),
    T.StructField("competence", _STR, True),
    T.StructField("filters_json", _STR, True),
    T.StructField("etag", _STR, True),
    T.StructField("resource_version", _STR, True),
    T.StructField("contract_version", _STR, False),
    T.StructField("accepted_count", _LONG, False),
    T.StructField("rows_read", _LONG, True),
    T.StructField("rows_rejected", _LONG, True),
    T.StructField("rows_ignored", _LONG, True),
    T.StructField("rejection_reasons", _STR, True),
    T.StructField("content_sha256", _STR, True),
    T.StructField("imported_at", _STR, False),
    T.StructField("written_at", _STR, True),
    T.StructField("removed", _BOOL, True),
    T.StructField("default_since", _STR, True),
])
