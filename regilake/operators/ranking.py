"""Exact whole-batch ranks without a single-task window.

``cume_dist`` / ``percent_rank`` over a whole batch are the same as
running sums over the value histogram. One pass over the input builds the
histograms of all ranked columns (one row per column and distinct value).
Each value falls into a bin that is a fixed, monotone function of the value
alone, so the running sums within bins and the bin totals agree whatever
the partitioning, without sampled bounds. No step holds more than one bin
of distinct values, or the bin totals of one key (at most 32,770 rows, from
64 x 256 bins a sign). NULL values sort last and count in N.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_DOUBLING = 256


def _bin(v: Column) -> Column:
    """Monotone bin of an integer: 256 to each doubling of its magnitude."""
    size = F.floor(F.log2(F.abs(v.cast("double")) + 1) * BINS_PER_DOUBLING)
    return F.when(v < 0, -size).otherwise(size).cast("int")


def value_ranks(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per (keys, ``_spec``, ``_v``): ``cnt``, ``cum`` (rows <= value, NULLS LAST), ``n``.

    ``_spec`` is the position of the column in ``values`` (integer columns).
    """
    keys = list(keys)
    entries = F.array(*[F.struct(F.lit(i).alias("_spec"), F.col(c).cast("bigint").alias("_v"))
                        for i, c in enumerate(values)])
    hist = (df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e._spec", "_e._v")
            .groupBy(*keys, "_spec", "_v").agg(F.count(F.lit(1)).alias("cnt")))
    hist = hist.withColumn("_null", F.col("_v").isNull().cast("int")) \
               .withColumn("_bin", F.coalesce(_bin(F.col("_v")), F.lit(0)))
    group = [*keys, "_spec"]
    place = [*group, "_null", "_bin"]
    within = Window.partitionBy(*place).orderBy("_v") \
                   .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("_null", "_bin") \
                   .rowsBetween(Window.unboundedPreceding, -1)
    bins = hist.groupBy(*place).agg(F.sum("cnt").alias("_total")) \
               .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))) \
               .withColumn("n", F.sum("_total").over(Window.partitionBy(*group)))
    out = hist.withColumn("_local", F.sum("cnt").over(within)).alias("h").join(
        bins.drop("_total").alias("b"),
        [F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in place])
    return out.select(*[F.col(f"h.{c}").alias(c) for c in group], "_v", "cnt",
                      (F.col("_local") + F.col("_offset")).alias("cum"), "n")


def rank_value(kind: str) -> Column:
    if kind == "cume_dist":
        return F.col("cum") / F.col("n")
    if kind == "percent_rank":
        return F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(
            (F.col("cum") - F.col("cnt")) / (F.col("n") - 1))
    raise ValueError(kind)


def join_ranks(df: DataFrame, ranks: DataFrame, specs: Sequence[tuple[str, str, str]],
               keys: Sequence[str] = ()) -> DataFrame:
    """Add each ``(column, kind, name)`` from the table of :func:`value_ranks`."""
    for i, (value, kind, name) in enumerate(specs):
        t = ranks.where(F.col("_spec") == i).select(
            *[F.col(k).alias(f"_rk_{k}") for k in keys], F.col("_v").alias("_rv"),
            rank_value(kind).alias(name))
        cond = [F.col(value).cast("bigint").eqNullSafe(F.col("_rv"))]
        cond += [F.col(k).eqNullSafe(F.col(f"_rk_{k}")) for k in keys]
        df = df.join(t, cond, "left").drop("_rv", *[f"_rk_{k}" for k in keys])
    return df


def with_ranks(df: DataFrame, specs: Sequence[tuple[str, str, str]],
               keys: Sequence[str] = ()) -> DataFrame:
    """Add several ranks (``cume_dist`` or ``percent_rank``) of integer columns."""
    return join_ranks(df, value_ranks(df, [value for value, _, _ in specs], keys), specs, keys)
