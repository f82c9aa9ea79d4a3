"""Both imports of the binding in one pass; choices of batches, units and cities reach the bed rows."""

import datetime as dt

import pytest

from regilake.operators.filters import for_batch
from regilake.sources.driver_tables import both_imports, registry_lake, revision_lake


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A few rows with repeated and null keys, unknown parts and every kind of quantity."""
    root = str(tmp_path_factory.mktemp("binding"))
    day = lambda y: dt.datetime(y, 3, 1)
    rows = {
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                     [(k, f"C{k}", k % 3, 1.0, "BUILDING") for k in (1, 2, 10, 14, 50, 51)] + [(2, "twin", 1, 1.0, "BUILDING")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(k, f"NATION_{k}", 0) for k in range(3)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string",
                 [(1, "a", "Brand#1", "ECONOMY"), (2, "b", "Brand#5", "LARGE"), (2, "b", "Brand#9", "PROMO"), (3, "c", "Brand#12", "X"), (None, "d", "Brand#2", "SMALL")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string",
                   [(i, (1, 2, 10, 14, 50, 51, None)[i % 7], "OF"[i % 2], day(1995 + i % 4), f"{i % 5 + 1}-X") for i in range(40)]
                   + [(3, 10, "F", day(1996), "1-X"), (None, 10, "F", day(1996), "1-X"), (41, 10, "O", None, "2-X")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string",
                     [(i % 45, (1, 2, 3, 99, None)[i % 5], (1.0, 2.0, 30.0, 49.0, 50.0, None)[i % 6 if i % 3 else 1], "RNA"[i % 3], "OF"[i % 2])
                      for i in range(200)] + [(None, 1, 3.0, "N", "O")]),
    }
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{root}/{name}.parquet")
    return root


def _rows(df):
    return sorted(map(str, df.collect()))


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_pass_gives_both_imports(spark, tables):
    one = both_imports(spark, tables)
    two = registry_lake(spark, tables).unionByName(revision_lake(spark, tables))
    assert one.columns == two.columns
    assert _rows(one) == _rows(two) and one.count() > 20
    assert _optimized(one).count("l_orderkey#") < _optimized(two).count("l_orderkey#")


def test_filters_of_both_imports(spark, tables):
    from pyspark.sql import functions as F
    lake = both_imports(spark, tables)
    assert _rows(both_imports(spark, tables, {"cnes_list": ["0000010"]})) == _rows(lake.where(F.col("cnes") == "0000010"))
    assert _rows(both_imports(spark, tables, {"min_leitos": 30})) == _rows(lake.where("leitos_existentes >= 30"))


def test_choice_of_a_batch_reaches_beds_and_qualifications(spark, tables):
    chosen = for_batch(registry_lake(spark, tables), "R199612")
    assert chosen.count() > 0
    # establishments, beds and qualifications each leave out other competences
    assert _optimized(chosen).count("= R199612") >= 3


@pytest.mark.parametrize("name", ["by_code", "timeseries_unit", "timeseries_city"])
def test_other_units_beds_leave_before_they_are_added(spark, tables, name):
    from regilake.plans.registered import REGISTRY
    plan = _optimized(REGISTRY[name](spark, tables))
    assert "Join LeftSemi" in plan


def test_rows_of_an_entry_are_added_up_before_the_unit(spark, tables):
    from regilake.sources.driver_tables import release_tables
    from regilake.sources.release import normalize_release
    plain, entered = release_tables(spark, tables), release_tables(spark, tables, by_entry=True)
    assert "lancamentos" in entered and "competencia" not in entered["leitos"].columns
    for filters in (None, {"cnes_list": ["0000010", "0000001"]}):
        assert _rows(normalize_release(entered, filters)) == _rows(normalize_release(plain, filters))
