"""Per-facility rollup of granular rows with most-frequent attribute values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Most frequent value of each column per key (ties -> smallest value).

    All columns go through one long-form pipeline (stack -> count ->
    min(struct(-count, value)) -> pivot on the fixed column list), so the
    cost is three partial-aggregated shuffles whatever the number of
    columns, and a hot key never collects its values in one task.
    """
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    long = rows.select(key, F.expr(f"stack({len(columns)}, {pairs}) AS (_name, _value)"))
    counted = long.groupBy(key, "_name", "_value").agg(F.count(F.lit(1)).alias("_n"))
    best = counted.groupBy(key, "_name").agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("_value").alias("v"))).alias("_b"))
    return best.groupBy(key).agg(
        *[F.max(F.when(F.col("_name") == c, F.col("_b.v"))).alias(c) for c in columns])


def top_bucket_rollup(rows: DataFrame, key: str, sums: Mapping[str, str],
                      modes: Sequence[str]) -> DataFrame:
    """``sums`` maps output name -> column summed; ``modes`` are most-frequent columns."""
    totals = rows.groupBy(key).agg(*[F.sum(src).cast("bigint").alias(out)
                                     for out, src in sums.items()])
    return totals.join(most_frequent(rows, key, modes), key, "left")
