"""Physical-plan properties that matter at scale."""

import os
import re

from regilake.operators.filters import apply_filters, for_batch
from regilake.operators import aggregate as AG
from regilake.sources import lake as LK
from regilake.sources.driver_tables import registry_lake

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lake_scan_prunes_partitions_and_pushes_filters(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "lake")
    LK.write_batches(registry_lake(spark, SF), root)
    lake = LK.read_facilities(spark, root)
    q = AG.aggregate_by(apply_filters(for_batch(lake, "R199712"), {"uf": "pa", "min_leitos": 10}),
                        "tipo", "leitos_existentes")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan and "R199712" in plan
    assert "PushedFilters: [IsNotNull(uf), IsNotNull(leitos_existentes), EqualTo(uf,PA)" in plan
    # Column pruning: the scan reads only what the query uses.
    assert "ReadSchema: struct<uf:string,tipo_estabelecimento:string,leitos_existentes:bigint>" in plan


def test_catalog_choice_prunes_the_lake(spark):
    from regilake.plans.registered import REGISTRY
    plan = REGISTRY["written_lake_by_state"](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "dynamicpruning" in plan.lower()


def test_lookups_are_broadcast_and_no_window_without_keys_on_data(spark):
    from regilake.plans.registered import REGISTRY
    plan = _plan(REGISTRY["score_leads"](spark, SF))
    assert "BroadcastHashJoin" in plan
    # ranks come from value bins: every window is partitioned
    for line in plan.splitlines():
        if "Window [" in line:
            assert "windowspecdefinition(" in line and not re.search(r"windowspecdefinition\([^,]* (ASC|DESC)", line)


def test_fetch_filters_reach_the_release_tables(spark):
    from regilake.plans.registered import REGISTRY
    plan = REGISTRY["fetch_filtered"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # bed and qualification rows of other units leave before they are aggregated
    assert plan.count("Join LeftSemi") >= 2


def test_no_nested_loop_in_lake_queries(spark):
    from regilake.plans.registered import REGISTRY
    for name in ("active_qualifications", "search_codes", "load_summary_events"):
        assert "NestedLoop" not in _plan(REGISTRY[name](spark, SF)), name
