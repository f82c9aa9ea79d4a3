"""Release ingest: normalise many months in one job and publish batches.

Data first (dynamic partition overwrite of exactly the written batches),
catalog rows last; a retried job rewrites the same partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Filters, filters_json
from ..sources import lake as LK
from ..sources.archives import ArchiveError, competence_of, land_releases, landed_tables, open_seekable
from ..sources.driver_tables import both_imports, release_imported_at, revision_imported_at
from ..sources.release import normalize_release


def ingest_binding(spark: SparkSession, sf_dir: str, root: str) -> dict[str, int]:
    """Normalise both imports of the driver-table binding into ``root`` in one job, one commit each."""
    LK.write_batches(both_imports(spark, sf_dir), root)
    counts = {}
    for name, prefix, imported_at in (("release", "R", release_imported_at()), ("revision", "V", revision_imported_at())):
        written = LK.read_facilities(spark, root).where(F.col("batch_id").startswith(prefix))
        entries = LK.catalog_entries(written, f"binding_{name}", imported_at)
        LK.append_catalog_rows(spark, root, entries)
        counts[name] = sum(e["accepted_count"] for e in entries)
    return counts


NORMALIZER_VERSION = "regilake-release-1"


def archive_hashes(spark: SparkSession, archives: Sequence[str]) -> dict[str, str]:
    """SHA-256 of each archive's bytes, read in pieces by one task per archive."""
    from ..session import ship_package
    ship_package(spark)
    sc = spark.sparkContext
    paths = spark.createDataFrame([(a,) for a in archives], "archive string") \
        .repartition(max(1, min(len(archives), 4 * sc.defaultParallelism)))

    def run(frames):
        import pandas as pd
        for frame in frames:
            rows = []
            for a in frame["archive"]:
                h = hashlib.sha256()
                with open_seekable(a) as f:
                    while piece := f.read(1 << 20):
                        h.update(piece)
                rows.append((a, h.hexdigest()))
            yield pd.DataFrame(rows, columns=["archive", "sha256"])

    return {r.archive: r.sha256 for r in paths.mapInPandas(run, "archive string, sha256 string").collect()}


def fetch_releases(spark: SparkSession, archives: Sequence[str], root: str, landing: str,
                   filters: Filters | Mapping[str, Any] | None = None, max_bytes: int | None = None) -> list[dict]:
    """Publish one batch per archive's competence, normalised with the filters pushed into the release tables.

    What an archive holds is told by the hash of its bytes: a batch whose
    bytes, normaliser version and filters are catalogued, and whose stored
    rows still number what its catalog row says, is used again; where rows
    are missing it is made anew. All new archives are landed, normalised and
    written in one job each, and published in one commit.
    """
    made = filters_json(filters)
    named = {a: competence_of(a) for a in archives}
    hashes = archive_hashes(spark, archives)
    todo = [{"path": a, "competence": named[a], "sha256": hashes[a],
             "version": f"{hashes[a]}:{NORMALIZER_VERSION}"} for a in archives]
    for v in todo:
        v["batch_id"] = LK.context_id(v["version"], "release_archive", v["competence"], made)
    if len({v["competence"] for v in todo}) < len(todo):
        raise ArchiveError("more than one archive for a competence")
    ids = [v["batch_id"] for v in todo]
    known = {r.batch_id: r.accepted_count for r in LK.catalog_if_any(spark, root).where(F.col("batch_id").isin(ids)).collect()}
    if known:
        stored = _stored(spark, root, list(known))
        todo = [v for v in todo if known.get(v["batch_id"], -1) != stored.get(v["batch_id"], 0)]
    if not todo:
        return []
    tables = land_releases(spark, [v["path"] for v in todo], landing, max_bytes)
    tables = landed_tables(tables, [v["competence"] for v in todo])
    batch = F.create_map(*[F.lit(x) for v in todo for x in (v["competence"], v["batch_id"])])  # one entry per archive
    rows = normalize_release(tables, filters).withColumn("batch_id", batch[F.col("competencia")])
    LK.write_batches(rows, root)
    counts = _stored(spark, root, [v["batch_id"] for v in todo])
    entries = [{"batch_id": v["batch_id"], "source": "release_archive", "competence": v["competence"],
                "resource_version": v["version"], "content_sha256": v["sha256"], "source_file": v["path"],
                "contract_version": "v2", "accepted_count": counts.get(v["batch_id"], 0), "filters_json": made} for v in todo]
    LK.append_catalog_rows(spark, root, entries)
    return entries


def _stored(spark: SparkSession, root: str, batch_ids: list[str]) -> dict[str, int]:
    """Rows in the lake by batch (footers and partition pruning; one row per batch)."""
    return {r.batch_id: r.n for r in LK.read_facilities(spark, root).where(F.col("batch_id").isin(batch_ids))
            .groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
