"""Ingest operators: exact dedupe, row validation, consolidation, audit.

Rows arrive as strings with an ``_ord`` ordinal (file order). Rejected
rows never leave this module with their values: only counts by reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nonneg_int
from ..functions.rules import competence_valid, parse_bool, slash_competence

TEXT_FIELDS = ("nome_fantasia", "municipio", "uf", "tipo_estabelecimento",
               "natureza_juridica", "gestao")


def exact_dedupe(raw: DataFrame, content: Sequence[str], ordinal: str = "_ord", within: Sequence[str] = ()) -> DataFrame:
    """Keep one row per exact content (the first in file order) + ``_copies``;
    ``within`` names columns (the file) whose values are deduplicated apart.

    The signature is SHA-256 of the JSON of the named columns (header names
    included). One shuffle: ``min(struct(ordinal, row))`` is combined map-side,
    so a key holding a third of all rows ships one partial row per task.
    """
    if len(content) == 1 and dict(raw.dtypes)[content[0]] == "string":
        sig = F.sha2(F.col(content[0]), 256)  # already a canonical text
    else:
        sig = F.sha2(F.to_json(F.struct(*[F.col(c) for c in content])), 256)
    # the JSON of all columns stays behind; the typed row travels with the ordinal
    others = [c for c in raw.columns if c != ordinal and c not in within and not c.startswith("_content")]
    firsts = raw.withColumn("_sig", sig).groupBy(*within, "_sig").agg(
        F.min(F.struct(F.col(ordinal), *[F.col(c) for c in others])).alias("_r"),
        F.count(F.lit(1)).alias("_copies"))
    return firsts.select(*within, "_r.*", "_copies")


def validate_rows(rows: DataFrame, has_sus_column: bool = True) -> DataFrame:
    """Typed v1 rows plus ``reject_reason`` (NULL = accepted).

    Code blank -> ``cnes_ausente`` (checked first); unparsable or negative
    bed count / flag, a competence that is no month, or a malformed CSV line (``_corrupt_record``) ->
    ``valor_invalido``. A ``_has_sus`` column, when present, says per row
    whether the source file had a SUS-bed column (flag default).
    """
    beds, beds_ok = nonneg_int("leitos_existentes")
    sus, sus_ok = nonneg_int("leitos_sus")
    flag_raw = F.coalesce(F.trim(F.col("convenio_sus")), F.lit(""))
    flag, flag_ok = parse_bool("convenio_sus")
    if "_has_sus" in rows.columns:
        default_flag = F.when(F.col("_has_sus"), sus > 0).otherwise(F.lit(True))
    else:
        default_flag = (sus > 0) if has_sus_column else F.lit(True)
    malformed = (F.col("_corrupt_record").isNotNull() if "_corrupt_record" in rows.columns
                 else F.lit(False))
    competence = slash_competence(F.coalesce(F.col("competencia"), F.lit("")))
    convenio = F.when(flag_raw != "", flag).otherwise(default_flag)
    cnes = F.coalesce(F.trim("cnes"), F.lit(""))
    reason = (F.when(cnes == "", F.lit("cnes_ausente"))
              .when(malformed | ~beds_ok | ~sus_ok
                    | ~((competence == "") | competence_valid(competence)) | ((flag_raw != "") & ~flag_ok),
                    F.lit("valor_invalido")))
    texts = [F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in TEXT_FIELDS]
    passthrough = [c for c in ("_file", "_copies") if c in rows.columns]
    return rows.select(
        "_ord", *passthrough, cnes.alias("cnes"), *texts,
        competence.alias("competencia"),
        beds.alias("leitos_existentes"), sus.alias("leitos_sus"),
        convenio.alias("convenio_sus"), reason.alias("reject_reason"))


def _first_non_empty(c: str, ordinal: str) -> Column:
    return F.coalesce(F.min(F.when(F.col(c) != "", F.struct(F.col(ordinal), F.col(c))))[c], F.lit(""))


def consolidate(accepted: DataFrame, ordinal: str = "_ord", keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, cnes, competencia): first non-empty text in file order,
    OR of the SUS flag, SUM of beds. All partial-aggregatable."""
    return accepted.groupBy(*keys, "cnes", "competencia").agg(
        *[_first_non_empty(c, ordinal).alias(c) for c in TEXT_FIELDS],
        F.bool_or("convenio_sus").alias("convenio_sus"),
        F.sum("leitos_existentes").cast("bigint").alias("leitos_existentes"),
        F.sum("leitos_sus").cast("bigint").alias("leitos_sus"))


def load_audit(validated: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """read / rejected / ignored rows and the reasons, per ``keys``, from the validated
    distinct rows alone (carrying ``_copies``): read = sum of copies, ignored = read - distinct rows."""
    per_reason = validated.groupBy(*keys, "reject_reason").agg(
        F.sum("_copies").alias("_read"), F.count(F.lit(1)).alias("_rows"))
    return per_reason.groupBy(*keys).agg(
        F.sum("_read").cast("bigint").alias("rows_read"),
        F.coalesce(F.sum(F.when(F.col("reject_reason").isNotNull(), F.col("_rows"))), F.lit(0))
         .cast("bigint").alias("rows_rejected"),
        (F.sum("_read") - F.sum("_rows")).cast("bigint").alias("rows_ignored"),
        F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.filter(F.collect_list(
            F.struct(F.col("reject_reason"), F.col("_rows"))), lambda x: x["reject_reason"].isNotNull())))),
            F.lit("{}")).alias("rejection_reasons"))


def load_summary(validated: DataFrame, consolidated: DataFrame) -> DataFrame:
    """One-row audit: the counts of the validated rows beside the number of consolidated rows (a scalar subquery)."""
    accepted = consolidated.agg(F.count(F.lit(1)).alias("n")).scalar()
    audit = load_audit(validated)
    return audit.select(F.coalesce("rows_read", F.lit(0)).alias("rows_read"), accepted.alias("accepted_count"),
                        "rows_rejected", F.coalesce("rows_ignored", F.lit(0)).alias("rows_ignored"), "rejection_reasons")


def content_digest(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Order-free multiset digest of canonical rows, per ``keys`` (one row, one column without).

    Per-row SHA-256 of the sorted-key JSON; the batch digest hashes the row
    count and the sums of the eight 4-byte slices (all 256 bits),
    so equal content gives an equal id whatever the partitioning.
    """
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
    slices = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]
    agg = rows.select(*keys, *[s.alias(f"_s{i}") for i, s in enumerate(slices)]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_s{i}").cast("decimal(38,0)").alias(f"_t{i}") for i in range(8)])
    return agg.select(*keys, F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in
                                                      ("_n", *(f"_t{i}" for i in range(8)))]), 256)
                      .alias("content_sha256"))
