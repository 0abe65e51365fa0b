"""Streaming ingest: an extension that feeds files to the index as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from lorewell.engine import Engine


def index_stream(spark: SparkSession, engine: Engine, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Index the Parquet files (content) that appear under ``path``.

    Indexing is idempotent by content, so a batch that is run again after a
    failure changes nothing.
    """
    rows = spark.readStream.schema("content string").parquet(path)
    writer = rows.writeStream.foreachBatch(lambda batch, _: engine.index(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
