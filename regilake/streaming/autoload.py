"""Landing-folder autoload: new CSV files become batches.

A file-source stream lists new files (``binaryFile`` with only the
``path`` column selected, so file contents are not read by the stream
itself); each micro-batch hands its new paths to the loader, which imports
them together: its number of jobs does not grow with the files. No
watermark is needed: a re-delivered file yields the same content digest,
hence the same batch id, and the loader skips known batches. Progress
lives in the stream checkpoint under the shared checkpoint folder.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession

from ..plans.load import load_csv_files
from ..session import checkpoint_dir

KEPT_RESULTS = 10_000


def autoload(spark: SparkSession, landing: str, root: str, max_files: int = 64,
             available_now: bool = True, checkpoint: str | None = None):
    """Start the stream; returns the StreamingQuery (``awaitTermination`` it).

    ``results`` holds the newest ``KEPT_RESULTS`` files' outcomes; the catalog has all.
    """
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/autoload"
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (spark.readStream.format("binaryFile").schema(schema)
             .option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", max_files)
             .load(landing).select("path"))
    results: deque[dict] = deque(maxlen=KEPT_RESULTS)

    def load_new(batch: DataFrame, batch_no: int) -> None:
        # One row per new file, bounded by maxFilesPerTrigger.
        paths = sorted(r["path"] for r in batch.collect())
        if paths:
            results.extend(load_csv_files(spark, paths, root))

    writer = files.writeStream.foreachBatch(load_new).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    query = writer.start()
    query.results = results  # type: ignore[attr-defined]
    return query
