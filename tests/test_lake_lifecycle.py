"""Removal and retention of batches on a written lake, and what readers see meanwhile."""

import os

import pytest

from conftest import lake_rows
from regilake.plans.registry import Registry
from regilake.sources import lake as LK


@pytest.fixture()
def root(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "lake")
    months = ["202401", "202402", "202403", "202404", "202405"]
    rows = [r for i, m in enumerate(months) for r in [dict(cnes=f"{j:07d}", competencia=m, batch_id=f"B{i}", uf="AM") for j in range(i + 1)]]
    LK.write_batches(lake_rows(spark, rows), root)
    LK.append_catalog_rows(spark, root, [{"batch_id": f"B{i}", "competence": m, "accepted_count": i + 1, "imported_at": f"2024-0{i + 1}-01"}
                                         for i, m in enumerate(months)])
    return root


def seen(spark, root):
    return {r.batch_id: r["count"] for r in LK.read_lake(spark, root).groupBy("batch_id").count().collect()}


def partitions(root):
    return sorted(d for _, dirs, _ in os.walk(LK.facilities_path(root)) for d in dirs if d.startswith("batch_id="))


def test_retention_keeps_the_default_and_the_newest(spark, root):
    LK.commit(spark, root, [{**LK.read_catalog(spark, root).where("batch_id = 'B1'").first().asDict(), "default_since": "2999"}])
    assert LK.default_batch(spark, root)["batch_id"] == "B1"
    gone = Registry(spark, root).retain(3)
    assert [(r["batch_id"], r["accepted_count"]) for r in gone] == [("B0", 1), ("B2", 3)]
    assert seen(spark, root) == {"B1": 2, "B3": 4, "B4": 5}
    assert partitions(root) == ["batch_id=B1", "batch_id=B3", "batch_id=B4"]
    assert Registry(spark, root).retain(3) == []
    assert [r.batch_id for r in Registry(spark, root).list_batches().collect()] == ["B4", "B3", "B1"]


def test_purge_hands_the_default_over(spark, root):
    reg = Registry(spark, root)
    assert reg.search(order_by="cnes")["batch_id"] == "B4"
    assert reg.purge("B4") == {"batch_id": "B4", "accepted_count": 5, "default": "B3"}
    assert reg.search(order_by="cnes")["batch_id"] == "B3"
    assert reg.purge("B0")["default"] == "B3"
    with pytest.raises(LK.ContractError, match="B4"):
        reg.purge("B4")
    for b in ("B1", "B2", "B3"):
        last = reg.purge(b)
    assert last["default"] is None and seen(spark, root) == {}


def test_a_run_stopped_before_deletion_leaves_readers_right(spark, root, monkeypatch):
    def stopped(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(LK, "sweep", stopped)
        with pytest.raises(RuntimeError):
            LK.remove_batches(spark, root, ["B0", "B4"])
    assert len(partitions(root)) == 5 and set(seen(spark, root)) == {"B1", "B2", "B3"}
    assert LK.default_batch(spark, root)["batch_id"] == "B3"
    # a batch that is written but not published yet is no tombstone
    LK.write_batch(lake_rows(spark, [dict(cnes="1", competencia="202406")]), root, "B9")
    assert LK.sweep(spark, root) == 2
    assert partitions(root) == ["batch_id=B1", "batch_id=B2", "batch_id=B3", "batch_id=B9"]
    assert set(seen(spark, root)) == {"B1", "B2", "B3"}


def test_a_removed_batch_can_come_back(spark, root):
    LK.remove_batches(spark, root, ["B2"])
    LK.write_batch(lake_rows(spark, [dict(cnes="1", competencia="202403")]), root, "B2")
    LK.append_catalog(spark, root, {"batch_id": "B2", "competence": "202403", "accepted_count": 1, "imported_at": "2025"})
    assert seen(spark, root)["B2"] == 1 and LK.sweep(spark, root) == 0
    assert LK.default_batch(spark, root)["batch_id"] == "B2"


def test_a_large_city_is_written_by_many_tasks(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "lake")
    rows = lake_rows(spark, [dict(cnes=f"{i:07d}", competencia="202401", uf="SP", municipio="SÃO PAULO" if i % 3 else f"C{i}") for i in range(3000)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        LK.write_batch(rows, root, "B")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = LK.read_facilities(spark, root).where("municipio = 'SÃO PAULO'").selectExpr("_metadata.file_path AS f").distinct().count()
    assert files >= 3
