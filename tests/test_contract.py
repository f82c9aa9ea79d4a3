"""Driver contract: entry smoke check and a Spark-vs-DuckDB sample at sf0.001."""


import re

import duckdb
import pytest

import __spark_entry__ as E
from regilake.sources.driver_tables import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ("agg_by_uf_avg", "search_page_beds", "validate_batches", "lead_triggers_history",
          "maintainer_groups", "score_leads_all", "consolidate_events", "annual_normalize")


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


def test_every_library_query_has_an_oracle():
    library = {q for q in E.queries() if not re.match(r"op\d+_|pipeline$", q)}
    assert library <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["batch_id", "grupo", "valor"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want
