"""regilake: facility-registry analytics as Spark DataFrame operators.

Batches of registry rows live in a partitioned Parquet lake
(``competencia=.../batch_id=...``); every operator is a lazy
DataFrame -> DataFrame function, so one call covers one batch or the
whole history.
"""

__version__ = "0.1.0"
