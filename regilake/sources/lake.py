"""Partitioned batch lake and its catalog.

Layout: ``<root>/facilities/competencia=YYYYMM/batch_id=<id>/*.parquet``
(zstd, rows sorted by uf, municipio_normalizado within files so Parquet
min/max statistics prune state / city filters) and ``<root>/batches``,
a small Parquet table. Data is written first and the catalog rows last;
readers go through the catalog, so a batch is visible only once complete.
Re-writing a batch replaces exactly its partitions (dynamic partition
overwrite), which makes retries after a lost executor or a failed job
idempotent.

The catalog is a log: a batch's newest row counts, and a commit appends
all its rows as one file, so readers see the whole commit or nothing of
it. A removed batch gets a tombstone row and vanishes at once; its
partitions are deleted afterwards, and :func:`sweep` finishes what a
stopped run left behind. The default batch is the one with the newest
``default_since``; a commit that removes it hands the default to the
newest batch left.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions.rules import competence_valid
from ..operators.filters import filters_json
from ..schema import CATALOG_SCHEMA, LAKE_COLUMNS, LAKE_SCHEMA

# Explicit read schema: partition values stay strings (no type inference).
STORED_SCHEMA = T.StructType(list(LAKE_SCHEMA.fields) + [T.StructField("batch_id", T.StringType())])


def read_facilities(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(STORED_SCHEMA).parquet(facilities_path(root))


def facilities_path(root: str) -> str:
    return f"{root.rstrip('/')}/facilities"


def catalog_path(root: str) -> str:
    return f"{root.rstrip('/')}/batches"


def write_batch(rows: DataFrame, root: str, batch_id: str) -> None:
    """Write one batch's rows (lake schema) into its partitions."""
    write_batches(rows.select(*LAKE_COLUMNS).withColumn("batch_id", F.lit(batch_id)), root)


def write_batches(rows: DataFrame, root: str) -> None:
    """Write rows carrying ``batch_id`` (many batches in one job).

    Rows are range-partitioned by (competencia, batch_id, uf, city, cnes), so
    each task writes few partition directories, files stay sorted for
    statistics, and neither a batch nor one large city goes to a single task.
    """
    out = rows.select(*LAKE_COLUMNS, "batch_id")
    (out.repartitionByRange("competencia", "batch_id", "uf", "municipio_normalizado", "cnes")
        .sortWithinPartitions("competencia", "batch_id", "uf", "municipio_normalizado", "cnes")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("competencia", "batch_id").parquet(facilities_path(root)))


def commit(spark: SparkSession, root: str, entries: Iterable[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """Append catalog rows as one file: all of them become visible, or none."""
    now = _dt.datetime.now(_dt.timezone.utc).isoformat()
    rows = []
    for e in entries:
        row = {f.name: e.get(f.name) for f in CATALOG_SCHEMA.fields} | {"written_at": now}
        row["imported_at"] = row["imported_at"] or now
        row["contract_version"] = row["contract_version"] or "v2"
        if isinstance(row["filters_json"], dict):
            row["filters_json"] = json.dumps(row["filters_json"], sort_keys=True, ensure_ascii=False)
        rows.append(row)
    if rows:
        spark.createDataFrame(rows, CATALOG_SCHEMA).coalesce(1).write.mode("append").parquet(catalog_path(root))
    return rows


def append_catalog(spark: SparkSession, root: str, entry: Mapping[str, Any]) -> dict[str, Any]:
    """Commit one batch and make it the default."""
    now = _dt.datetime.now(_dt.timezone.utc).isoformat()
    return commit(spark, root, [{**entry, "default_since": now}])[0]


def append_catalog_rows(spark: SparkSession, root: str, entries: Iterable[Mapping[str, Any]]) -> None:
    """Commit many batches at once; the newest import of them becomes the default."""
    entries = [dict(e) for e in entries]
    now = _dt.datetime.now(_dt.timezone.utc).isoformat()
    if entries:
        max(entries, key=lambda e: (e.get("imported_at") or now, e["batch_id"]))["default_since"] = now
    commit(spark, root, entries)


def _newest_rows(spark: SparkSession, root: str) -> DataFrame:
    cat = spark.read.schema(CATALOG_SCHEMA).parquet(catalog_path(root))
    w = Window.partitionBy("batch_id").orderBy(F.desc("written_at"), F.desc("imported_at"))
    return cat.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per visible batch: its newest one, unless that is a tombstone."""
    return _newest_rows(spark, root).where(~F.coalesce("removed", F.lit(False)))


def default_batch(spark: SparkSession, root: str) -> dict[str, Any] | None:
    """The default batch's row: the newest hand-over, for old catalogs the newest import."""
    found = read_catalog(spark, root).orderBy(F.desc_nulls_last("default_since"), F.desc("imported_at"), F.desc("batch_id")).limit(1).collect()
    return found[0].asDict() if found else None


def remove_batches(spark: SparkSession, root: str, batch_ids: Iterable[str]) -> list[dict[str, Any]]:
    """Remove batches: one commit of tombstones and, if the default goes, its hand-over; then their partitions.

    Returns ``batch_id`` and ``accepted_count`` (rows removed) of each. A query
    that began before may still hold the removed files and fail on them.
    """
    ids = sorted(set(batch_ids))
    rows = {r["batch_id"]: r.asDict() for r in read_catalog(spark, root).collect()}  # one row a batch
    unknown = [i for i in ids if i not in rows]
    if unknown:
        raise ContractError(f"unknown batches: {unknown}")
    if not ids:
        return []
    entries = [{**rows[i], "removed": True, "default_since": None} for i in ids]
    left = [r for i, r in rows.items() if i not in ids]
    if left and default_batch(spark, root)["batch_id"] in ids:
        heir = max(left, key=lambda r: (r["imported_at"], r["batch_id"]))
        entries.append({**heir, "default_since": _dt.datetime.now(_dt.timezone.utc).isoformat()})
    commit(spark, root, entries)
    sweep(spark, root)
    return [{"batch_id": i, "accepted_count": rows[i]["accepted_count"]} for i in ids]


def retain(spark: SparkSession, root: str, keep: int, current: str | None = None) -> list[dict[str, Any]]:
    """Keep ``current`` and the newest others up to ``keep`` batches in all; remove the rest."""
    victims = retention_victims(read_catalog(spark, root), keep, current).select("batch_id").collect()  # catalog-sized
    return remove_batches(spark, root, [r["batch_id"] for r in victims])


def sweep(spark: SparkSession, root: str) -> int:
    """Delete partitions whose batch is a tombstone; partitions not catalogued yet are left alone. Returns how many went."""
    gone = [r["batch_id"] for r in _newest_rows(spark, root).where("removed").select("batch_id").collect()]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base, deleted = jvm.org.apache.hadoop.fs.Path(facilities_path(root)), 0
    fs = base.getFileSystem(conf)
    for batch_id in gone:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch_id)
        for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(base, f"competencia=*/batch_id={name}")) or []:
            deleted += bool(fs.delete(st.getPath(), True))
    return deleted


def catalog_if_any(spark: SparkSession, root: str) -> DataFrame:
    """The catalog, empty where none was written yet; any other fault is raised."""
    try:
        return read_catalog(spark, root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CATALOG_SCHEMA)


def catalog_entries(written: DataFrame, source: str, imported_at: Column,
                    extra: Mapping[str, Any] | None = None) -> list[dict]:
    """Catalog rows of batches just written, from their files; ``imported_at`` is an expression over ``competencia``."""
    per_batch = written.groupBy("batch_id", "competencia").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("imported_at", imported_at).groupBy("batch_id").agg(
            F.sum("n").alias("accepted_count"), F.max("imported_at").alias("imported_at"),
            F.array_join(F.array_sort(F.collect_list("competencia")), ",").alias("competence"))
    return [{"batch_id": r["batch_id"], "source": source, "competence": r["competence"],
             "accepted_count": int(r["accepted_count"]), "imported_at": r["imported_at"],
             "contract_version": "v2", "filters_json": "{}", **(extra or {})}
            for r in per_batch.collect()]  # one row per batch


def read_lake(spark: SparkSession, root: str, catalog: DataFrame | None = None) -> DataFrame:
    """Lake rows of catalogued batches only (half-written batches stay hidden)."""
    cat = catalog if catalog is not None else read_catalog(spark, root)
    lake = read_facilities(spark, root)
    joined = lake.join(cat.select("batch_id", "imported_at"), "batch_id")
    return joined.select(*LAKE_COLUMNS, "batch_id", "imported_at")


def list_catalogued(catalog: DataFrame) -> DataFrame:
    """Newest first: rows and competences per batch, from the catalog alone."""
    return catalog.select("batch_id", F.col("accepted_count").alias("registros"), F.col("competence").alias("competencias"),
                          "source", "filters_json", "imported_at").orderBy(F.desc("imported_at"), F.desc("batch_id"))


def list_batches(lake: DataFrame) -> DataFrame:
    """Newest first: rows and competences per batch, counted (for lakes without a catalog)."""
    return lake.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("registros"),
        F.array_join(F.array_sort(F.collect_set("competencia")), ",").alias("competencias"),
        F.max("imported_at").alias("imported_at")).orderBy(F.desc("imported_at"), F.desc("batch_id"))


def retention_victims(batches: DataFrame, keep: int, current: str | None = None) -> DataFrame:
    """Batches to drop: all but the current one and the newest ``keep - 1`` others.

    ``batches`` is one row per batch (catalog-sized), so the global
    ordering window here runs over the catalog, not over the data.
    """
    if keep < 1:
        raise ValueError("keep must be >= 1")
    w = Window.orderBy(F.desc("imported_at"), F.desc("batch_id"))
    others = batches if current is None else batches.where(F.col("batch_id") != current)
    slots = keep if current is None else keep - 1
    ranked = others.withColumn("_pos", F.row_number().over(w))
    return ranked.where(F.col("_pos") > slots).drop("_pos")


class ContractError(ValueError):
    pass


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the digests of the files' bytes, whatever their names, order and place.

    Each file is hashed in a task; of the digests only the sums of their
    eight 4-byte slices come back.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    digest = F.sha2("content", 256)
    parts = files.select("length", *[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"s{i}") for i in range(8)])
    r = parts.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size"),
                  *[F.sum(f"s{i}").cast("decimal(38,0)").alias(f"s{i}") for i in range(8)]).first()
    return hashlib.sha256(":".join(str(x) for x in r).encode()).hexdigest()


def check_contract(schema: T.StructType) -> None:
    """Exactly the lake's columns with exactly its types (nullability aside), else ContractError."""
    found = {f.name: f.dataType for f in schema.fields if f.name not in ("batch_id", "imported_at")}
    wanted = {f.name: f.dataType for f in LAKE_SCHEMA.fields}
    missing, extra = sorted(set(wanted) - set(found)), sorted(set(found) - set(wanted))
    wrong = [f"{n}: {found[n].simpleString()} instead of {wanted[n].simpleString()}"
             for n in wanted if n in found and found[n].simpleString() != wanted[n].simpleString()]
    if missing or extra or wrong:
        raise ContractError(f"contract mismatch: missing={missing} extra={extra} types={wrong}")


def context_id(content: str, source: str, competence: str | None, filters: str) -> str:
    """Batch id: digest of a length-prefixed list of the content's digest and its origin."""
    fields = [content, source, competence or "", filters]
    return hashlib.sha256("".join(f"{len(f)}:{f}" for f in fields).encode("utf-8")).hexdigest()


def register_parquet(spark: SparkSession, path: str, root: str, source: str = "parquet",
                     competence: str | None = None, filters: Mapping[str, Any] | None = None,
                     resource_version: str | None = None, etag: str | None = None) -> dict[str, Any]:
    """Register existing v2 Parquet files as a batch.

    The footers of all files are read: columns must be exactly the lake
    contract (missing and extra ones are refused, a privacy allow-list), and
    so must their types; nothing is cast. The id comes from the resource
    version, or else from the files' bytes, with source, competence and
    filters: the same file registered again is the same batch, whose
    provenance is updated while counts and ``imported_at`` stay.
    """
    df = spark.read.option("mergeSchema", True).parquet(path)
    check_contract(df.schema)
    made = filters_json(filters)
    content = resource_version or file_digest(spark, path)
    batch_id = context_id(hashlib.sha256(content.encode()).hexdigest(), source, competence, made)
    known = catalog_if_any(spark, root).where(F.col("batch_id") == batch_id).first()
    entry = known.asDict() if known else {"batch_id": batch_id, "contract_version": "v2"}
    if known is None:
        write_batch(df, root, batch_id)
        # bounded: months are checked by pattern, other values count as one
        month = F.when(competence_valid("competencia"), F.col("competencia"))
        stored = read_facilities(spark, root).where(F.col("batch_id") == batch_id) \
            .agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(month)), ",").alias("months")).first()
        entry |= {"accepted_count": stored["n"], "rows_read": stored["n"], "competence": competence or stored["months"], "content_sha256": content}
    entry |= {"source": source, "filters_json": made, "etag": etag, "resource_version": resource_version, "source_file": path}
    if competence:
        entry["competence"] = competence
    return append_catalog(spark, root, entry)
