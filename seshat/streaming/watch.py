"""Watching a folder: new files arrive as a stream, and each micro-batch re-indexes what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, root: str, checkpoint: str, index: Callable[[DataFrame, int], None], *, interval: str | None = None) -> StreamingQuery:
    """Calls index(changed, batch_id) with (path, value) of new ``*.md`` files, once for each micro-batch.

    Without an interval it takes what is there and ends. Deleted files are no events of a stream: an index
    compares its snapshot with a listing of the folder in each batch (operators.reconcile.plan).
    """
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    rows = files.selectExpr("_metadata.file_path AS path", "value")
    writer = rows.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
