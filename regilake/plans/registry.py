"""User-facing facade over a lake root: one method per registry tool.

Argument checks and batch resolution run on the driver against the
catalog (one row per batch); every method returns lazy DataFrames (or a
small dict of them) built from the partition-pruned lake.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as AG
from ..operators import history as H
from ..operators import network as NW
from ..operators import quality as QA
from ..operators import scoring as SC
from ..operators import search as SE
from ..operators.filters import for_batch
from ..sources import lake as LK
from . import export as EX
from .load import load_csv
from .release_ingest import fetch_releases

FILTER_WARNING = ("batches were collected with different source filters; entries and exits "
                  "may reflect coverage, not registry changes")


class BatchError(ValueError):
    pass


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    # -- catalog and batch resolution -------------------------------------------------
    def catalog(self) -> DataFrame:
        return LK.read_catalog(self.spark, self.root)

    def lake(self) -> DataFrame:
        return LK.read_lake(self.spark, self.root)

    def _batch_row(self, batch_id: str | None) -> dict[str, Any]:
        cat = self.catalog()
        if batch_id is None:
            row = LK.default_batch(self.spark, self.root)
            if row is None:
                raise BatchError("no batch loaded")
            return row
        rows = cat.where(F.col("batch_id") == batch_id).collect()  # at most one row
        if not rows:
            raise BatchError(f"unknown batch: {batch_id}")
        return rows[0].asDict()

    def batch_for_competence(self, competence: str, batch_id: str | None = None) -> dict[str, Any]:
        """Explicit id wins; otherwise exactly one v2 batch of that competence."""
        if batch_id is not None:
            return self._batch_row(batch_id)
        cands = (self.catalog().where((F.col("contract_version") == "v2")
                                      & (F.col("competence") == competence))
                 .select("batch_id").collect())  # catalog-sized
        if len(cands) != 1:
            ids = sorted(r["batch_id"] for r in cands)
            raise BatchError(f"competence {competence} needs exactly one v2 batch; candidates: {ids}")
        return self._batch_row(cands[0]["batch_id"])

    def _rows(self, batch_id: str | None) -> tuple[dict[str, Any], DataFrame]:
        b = self._batch_row(batch_id)
        return b, for_batch(self.lake(), b["batch_id"])

    @staticmethod
    def _warnings(a: Mapping[str, Any], b: Mapping[str, Any]) -> list[str]:
        return [] if (a.get("filters_json") or "{}") == (b.get("filters_json") or "{}") \
            else [FILTER_WARNING]

    # -- tools ------------------------------------------------------------------------
    def search(self, filters=None, order_by="cnes", offset=0, limit=50, batch_id=None, v2=False):
        b, rows = self._rows(batch_id)
        if v2 and b["contract_version"] != "v2":
            raise BatchError("the selected batch uses the v1 contract")
        page, total = SE.search(rows, filters, order_by, offset, limit, v2=v2)
        return {"batch_id": b["batch_id"], "rows": page, "total": total}

    def by_municipality(self, name, limit=50, order_by="leitos_existentes", batch_id=None, **filters):
        """``filters``: uf, tipo_estabelecimento, natureza_juridica, gestao, convenio_sus, min_leitos, max_leitos."""
        b, rows = self._rows(batch_id)
        page, total = SE.by_municipality(rows, name, filters, order_by, limit)
        return {"batch_id": b["batch_id"], "rows": page, "total": total}

    def by_uf(self, uf, limit=100, order_by="leitos_existentes", batch_id=None, **filters):
        """``filters``: municipio and those of :meth:`by_municipality`."""
        b, rows = self._rows(batch_id)
        page, total = SE.by_uf(rows, uf, filters, order_by, limit)
        return {"batch_id": b["batch_id"], "rows": page, "total": total}

    def by_code(self, code: str) -> DataFrame:
        return SE.by_code(self.lake(), code)

    def statistics(self, batch_id=None):
        _, rows = self._rows(batch_id)
        return {"totals": AG.statistics(rows), "per_uf": AG.statistics_by_uf(rows)}

    def aggregate(self, group_by, metric, filters=None, batch_id=None) -> DataFrame:
        from ..operators.filters import apply_filters
        _, rows = self._rows(batch_id)
        return AG.aggregate_by(apply_filters(rows, filters), group_by, metric)

    def validate(self, batch_id=None) -> DataFrame:
        _, rows = self._rows(batch_id)
        return QA.validate(rows)

    def timeseries(self, key, key_type, start, end) -> DataFrame:
        return H.timeseries(self.lake(), key, key_type, start, end)

    def diff(self, batch_a, batch_b):
        a, b = self._batch_row(batch_a), self._batch_row(batch_b)
        return {"changes": H.diff(self.lake(), a["batch_id"], b["batch_id"]),
                "warnings": self._warnings(a, b)}

    def group_by_maintainer(self, filters=None, limit=20, batch_id=None):
        b, rows = self._rows(batch_id)
        if b["contract_version"] != "v2":
            raise BatchError("maintainer grouping needs a v2 batch")
        groups, dist, missing = NW.maintainer_groups(rows, filters, limit)
        return {"groups": groups, "uf_distribution": dist, "without_maintainer": missing}

    def lead_triggers(self, competence_a, competence_b, delta_min, establishment_type=None,
                      batch_a=None, batch_b=None):
        if not competence_a < competence_b:
            raise BatchError("competence A must precede competence B")
        a = self.batch_for_competence(competence_a, batch_a)
        b = self.batch_for_competence(competence_b, batch_b)
        t = H.lead_triggers(self.lake(), a["batch_id"], b["batch_id"], delta_min, establishment_type)
        return {"triggers": t.where(F.col("motivo").isNotNull()).drop("leitos_ausentes"),
                "omitted": t.agg(F.count_if("leitos_ausentes").alias("omitidos")),
                "warnings": self._warnings(a, b)}

    def score_leads(self, competence_a, competence_b, weights, filters=None, limit=50,
                    batch_a=None, batch_b=None):
        if not competence_a < competence_b:
            raise BatchError("competence A must precede competence B")
        a = self.batch_for_competence(competence_a, batch_a)
        b = self.batch_for_competence(competence_b, batch_b)
        lake = self.lake()
        scored = SC.score_leads(for_batch(lake, b["batch_id"]), for_batch(lake, a["batch_id"]),
                                weights, filters)
        return {"leads": SC.top_leads(scored, limit), "warnings": self._warnings(a, b)}

    def list_batches(self) -> DataFrame:
        return LK.list_catalogued(self.catalog())

    def retention_victims(self, keep: int, current: str | None = None) -> DataFrame:
        return LK.retention_victims(self.list_batches(), keep, current)

    def purge(self, batch_id: str) -> dict[str, Any]:
        """Remove one batch; the newest one left becomes the default if it was that."""
        gone = LK.remove_batches(self.spark, self.root, [batch_id])[0]
        default = LK.default_batch(self.spark, self.root)
        return {**gone, "default": default and default["batch_id"]}

    def retain(self, keep: int) -> list[dict[str, Any]]:
        """Keep the default batch and the newest others, ``keep`` in all."""
        default = LK.default_batch(self.spark, self.root)
        return LK.retain(self.spark, self.root, keep, default and default["batch_id"])

    def register(self, path: str, **context) -> dict[str, Any]:
        return LK.register_parquet(self.spark, path, self.root, **context)

    def normalize(self, paths: Sequence[str], dest: str) -> dict[str, Any]:
        from .normalize import normalize_csv
        return normalize_csv(self.spark, list(paths), dest)

    def competences(self, rows: DataFrame, column: str, year: int | None = None) -> DataFrame:
        from ..sources.manifest import competences_in_file
        return competences_in_file(rows, column, year)

    def export(self, fmt, dest, filters=None, codes=None, order_by="cnes", offset=0, limit=None,
               profile=None, batch_id=None):
        b = self._batch_row(batch_id)  # resolved once: the export is a snapshot
        if profile and b["contract_version"] != "v2":
            raise BatchError("the CRM profile needs a v2 batch")
        return EX.export(self.lake(), b["batch_id"], fmt, dest, filters, codes, order_by,
                         offset, limit, profile, etag=b.get("etag"))

    def load(self, paths: Sequence[str]) -> dict[str, Any]:
        return load_csv(self.spark, list(paths), self.root)

    def fetch(self, archives: Sequence[str], landing: str, filters: Mapping[str, Any] | None = None) -> list[dict]:
        return fetch_releases(self.spark, list(archives), self.root, landing, filters)
