"""Nested aggregation payloads (terms buckets) -> facility rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import bed_range, prefix_any

_TERMS = "struct<buckets:array<struct<key:string>>>"
_BUCKET = (f"struct<key:string,total_leitos:struct<value:double>,"
           f"total_leitos_sus:struct<value:double>,nome_fantasia:{_TERMS},"
           f"gestao:{_TERMS},natureza:{_TERMS},uf:{_TERMS}>")
_AGGS = f"struct<por_cnes:struct<buckets:array<{_BUCKET}>>>"
PAYLOAD_SCHEMA = f"struct<aggregations:{_AGGS},result:struct<rawResponse:struct<aggregations:{_AGGS}>>>"


def _first_key(terms: Column) -> Column:
    return F.coalesce(F.element_at(terms["buckets"], 1)["key"], F.lit(""))


def flatten_buckets(payloads: DataFrame, json_col: str, municipality: str, competence: str,
                    nature_codes: Sequence[str], min_beds: int | None = None,
                    max_beds: int | None = None) -> DataFrame:
    """One row per bucket that passes the bed range and the nature prefix rule.

    A payload may be a one-element list and may wrap the response in
    ``result.rawResponse``; both are unwrapped with JSON path functions.
    """
    text = F.trim(F.col(json_col))
    unwrapped = F.when(text.startswith("["), F.get_json_object(text, "$[0]")).otherwise(text)
    p = F.from_json(unwrapped, PAYLOAD_SCHEMA)
    aggs = F.when(p["result"].isNotNull(), p["result"]["rawResponse"]["aggregations"]) \
            .otherwise(p["aggregations"])
    b = payloads.select(F.explode(aggs["por_cnes"]["buckets"]).alias("b")).select("b.*")
    beds = F.coalesce(F.col("total_leitos")["value"], F.lit(0.0)).cast("bigint")
    out = b.select(
        F.lit(competence).alias("competencia"), _first_key(F.col("uf")).alias("uf"),
        F.lit(municipality).alias("municipio"), F.coalesce("key", F.lit("")).alias("cnes"),
        _first_key(F.col("nome_fantasia")).alias("nome_fantasia"),
        F.lit("").alias("tipo_estabelecimento"),
        _first_key(F.col("natureza")).alias("natureza_juridica"),
        _first_key(F.col("gestao")).alias("gestao"),
        beds.alias("leitos_existentes"),
        F.coalesce(F.col("total_leitos_sus")["value"], F.lit(0.0)).cast("bigint").alias("leitos_sus"),
        F.lit(True).alias("convenio_sus"))
    return out.where(bed_range("leitos_existentes", min_beds, max_beds)
                     & prefix_any("natureza_juridica", nature_codes))
