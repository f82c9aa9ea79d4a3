import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from regilake.operators.ranking import with_ranks


def test_histogram_ranks_equal_window_functions(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([None, 0, 1, 2, 2, 5, 9, 9, 40]), "A" if i % 3 else "B") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v int, k string")
    ours = with_ranks(df, [("v", "cume_dist", "cd"), ("v", "percent_rank", "pr")], keys=["k"])
    w = Window.partitionBy("k").orderBy(F.asc_nulls_last("v"))
    ref = df.select("id", F.cume_dist().over(w).alias("cd"), F.percent_rank().over(w).alias("pr"))
    a = {r["id"]: (r["cd"], r["pr"]) for r in ours.collect()}
    b = {r["id"]: (r["cd"], r["pr"]) for r in ref.collect()}
    assert a.keys() == b.keys()
    for key in a:
        assert abs(a[key][0] - b[key][0]) < 1e-12 and abs(a[key][1] - b[key][1]) < 1e-12


def test_single_row_percent_rank_is_zero(spark):
    df = spark.createDataFrame([(1, 5)], "id int, v int")
    r = with_ranks(df, [("v", "percent_rank", "pr"), ("v", "cume_dist", "cd")]).first()
    assert r["pr"] == 0.0 and r["cd"] == 1.0


def test_ranks_do_not_rest_on_a_reused_exchange(spark):
    df = spark.range(60_000).select("id", ((F.col("id") * 7919) % 9973 - 4000).alias("v"))
    w = Window.orderBy("v")
    want = df.select("id", F.cume_dist().over(w).alias("cd"))
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    try:
        for value in ("true", "false"):
            spark.conf.set("spark.sql.exchange.reuse", value)
            ours = with_ranks(df, [("v", "cume_dist", "got")]).join(want, "id")
            assert ours.where(F.abs(F.col("got") - F.col("cd")) > 1e-12).count() == 0
            assert ours.count() == 60_000
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
