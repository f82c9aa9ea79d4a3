"""Tool facade: batch resolution, contract checks, warnings."""

import os

import pytest

from conftest import lake_rows
from regilake.plans.registry import BatchError, Registry
from regilake.sources import lake as LK


def _setup(spark, root):
    a = lake_rows(spark, [dict(cnes="0000001", competencia="202501", leitos_existentes=100,
                               leitos_sus=70, cnpj_mantenedora="1", uf="AM"),
                          dict(cnes="0000002", competencia="202501", leitos_existentes=50,
                               leitos_sus=50, cnpj_mantenedora="2", uf="AM")])
    b = lake_rows(spark, [dict(cnes="0000001", competencia="202502", leitos_existentes=130,
                               leitos_sus=60, cnpj_mantenedora="1", uf="AM"),
                          dict(cnes="0000003", competencia="202502", leitos_existentes=80,
                               leitos_sus=0, cnpj_mantenedora="1", uf="PA")])
    LK.write_batch(a, root, "A")
    LK.write_batch(b, root, "B")
    LK.append_catalog_rows(spark, root, [
        {"batch_id": "A", "competence": "202501", "accepted_count": 2, "contract_version": "v2",
         "imported_at": "2025-02-01", "filters_json": "{}"},
        {"batch_id": "B", "competence": "202502", "accepted_count": 2, "contract_version": "v2",
         "imported_at": "2025-03-01", "filters_json": '{"uf": "AM"}'}])
    return Registry(spark, root)


def test_facade_resolution_and_tools(spark, tmpdir_path):
    reg = _setup(spark, os.path.join(tmpdir_path, "lake"))
    res = reg.search(order_by="leitos_existentes", limit=5)
    assert res["batch_id"] == "B" and res["total"].first()["total"] == 2
    t = reg.lead_triggers("202501", "202502", 20)
    assert {r["motivo"] for r in t["triggers"].collect()} == {"expansao", "entrada", "saida"}
    assert t["warnings"]  # source filters differ
    leads = reg.score_leads("202501", "202502", {"porte": 1, "complexidade": 0,
                                                 "mix_pagador": 0, "tendencia": 0}, limit=1)
    assert leads["leads"].first()["cnes"] == "0000001"
    with pytest.raises(BatchError):
        reg.batch_for_competence("209912")
    with pytest.raises(BatchError):
        reg.lead_triggers("202502", "202501", 20)
    assert [r["batch_id"] for r in reg.list_batches().collect()] == ["B", "A"]
    assert [r["batch_id"] for r in reg.retention_victims(1).collect()] == ["A"]
