"""Benchmark: prints ONE JSON line.

1. csv_import -- the reference's only published benchmark is a CSV import
   (400k rows -> 90.6 s). A granular registry CSV is derived from the
   driver's lineitem/orders/customer/nation tables (setup, untimed), then
   imported as one batch: sniff -> exact dedupe -> validate -> consolidate
   -> content digest -> partitioned Parquet + catalog.
2. release_ingest -- nine release tables (bound to the driver tables)
   normalised for every competence in one job, written as 14 batches.
3. queries -- the registered analytic queries, the same plans as the correctness check.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from regilake.operators import aggregate as AG  # noqa: E402
from regilake.operators import history as H  # noqa: E402
from regilake.operators import network as NW  # noqa: E402
from regilake.operators import quality as QA  # noqa: E402
from regilake.operators import search as SE  # noqa: E402
from regilake.operators.filters import for_batch  # noqa: E402
from regilake.plans.load import load_csv  # noqa: E402
from regilake.plans.registered import REGISTRY  # noqa: E402
from regilake.plans.release_ingest import ingest_binding  # noqa: E402
from regilake.session import build_session  # noqa: E402
from regilake.sources import lake as LK  # noqa: E402
from regilake.sources.driver_tables import read_table  # noqa: E402

QUERIES = (
    "agg_by_uf_beds", "agg_by_natureza_filtered", "statistics_totals", "search_page_beds",
    "validate_batches", "timeseries_all_cities", "diff_changed", "lead_triggers",
    "lead_triggers_history", "maintainer_groups", "score_leads", "batches_listing",
    "bed_pivot_poison", "active_qualifications", "consolidate_events",
    "exact_dedupe_documents", "norm_text_documents", "top_bucket_rollup", "crm_projection",
)


def written_lake_queries(spark, root: str) -> dict:
    """The same operators over the written lake, as a user of the registry meets them."""
    lake = LK.read_lake(spark, root)
    pair = ("R199612", "R199712")
    return {
        "agg_by_uf_beds": AG.aggregate_by(lake, "uf", "leitos_existentes"),
        "search_page_beds": SE.search(for_batch(lake, pair[0]), {"min_leitos": 100}, "leitos_existentes", 20, 50)[0],
        "validate_batches": QA.validate(lake, rollup="ALL"),
        "timeseries_all_cities": H.timeseries(lake, None, "municipio", "000000", "999999"),
        "diff_changed": H.diff(lake, *pair),
        "lead_triggers": H.lead_triggers(lake, *pair, 20),
        "maintainer_groups": NW.maintainer_groups(for_batch(lake, pair[1]), None, limit=25)[0],
        "batches_listing": LK.list_catalogued(LK.read_catalog(spark, root)),
    }


def derive_csv(spark, sf_dir: str, out_dir: str) -> tuple[str, int]:
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    rows = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(c, F.col("o_custkey") == F.col("c_custkey"))
              .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")))
    csv_rows = rows.select(
        F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("CNES"),
        F.col("c_name").alias("NOME FANTASIA"),
        F.col("n_name").alias("MUNICÍPIO"),
        F.substring("n_name", 1, 2).alias("UF"),
        F.col("c_mktsegment").alias("TIPO_ESTABELECIMENTO"),
        F.col("l_quantity").cast("bigint").cast("string").alias("LEITOS EXISTENTES"),
        F.when(F.col("l_returnflag") == "R", F.lit("0"))
         .otherwise(F.floor(F.col("l_quantity") / 2).cast("string")).alias("LEITOS SUS"),
        F.date_format("o_orderdate", "yyyy/MM").alias("COMPETÊNCIA"))
    path = os.path.join(out_dir, "registry_csv")
    csv_rows.coalesce(1).write.option("header", True).csv(path)
    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".csv")]
    return files[0], csv_rows.count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="regilake-bench-", dir="/tmp")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, extra={
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
        "spark.local.dir": scratch,
        "spark.checkpoint.dir": os.path.join(scratch, "checkpoints"),
    })

    csv_path, csv_rows = derive_csv(spark, sf_dir, scratch)
    # Untimed warm-up (JIT, codegen caches): the fixture CSVs and one tiny query.
    fixtures = os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests", "fixtures")
    load_csv(spark, [os.path.join(fixtures, "granular_duplicate.csv")], os.path.join(scratch, "warm"))
    REGISTRY["agg_by_uf_beds"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    t0 = time.time()
    summary = load_csv(spark, [csv_path], os.path.join(scratch, "csv_lake"))
    csv_sec = time.time() - t0

    lake_root = os.path.join(scratch, "lake")
    t0 = time.time()
    counts = ingest_binding(spark, sf_dir, lake_root)
    ingest_sec = time.time() - t0

    times = {}
    for name in QUERIES:
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = sum(times.values())
    written = {}
    for name, df in written_lake_queries(spark, lake_root).items():
        t0 = time.time()
        df.write.format("noop").mode("overwrite").save()
        written[name] = round(time.time() - t0, 3)
    print(json.dumps({
        "metric": "registered_queries_total", "value": round(total, 3), "unit": "sec",
        "queries": {"csv_import": round(csv_sec, 3), "release_ingest": round(ingest_sec, 3),
                    **times},
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "written_lake_queries": written,
        "csv_import_rows": csv_rows,
        "csv_import_rows_per_sec": round(csv_rows / csv_sec, 1),
        "baseline_csv_import_rows_per_sec": 4415.0,
        "csv_import_accepted": summary["accepted_count"],
        "release_ingest_rows": sum(counts.values()),
        "cpus": cpus,
        "warmup": "fixture CSV load + one sf0.001 query, untimed",
    }))


if __name__ == "__main__":
    main()
