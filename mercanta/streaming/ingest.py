"""Streaming forms of the collection cycle: an extension, since the reference only runs batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mercanta.sources.sinks import append_ignore


def listing_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_new(stream: DataFrame, path: str, key: Sequence[str], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Append what the key lets in, batch by batch, for all files that are there. A batch that runs again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        append_ignore(batch.sparkSession, path, batch, key, [F.col(c) for c in order])

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, time: str, key: Sequence[str], late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark; state is dropped once it has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def windowed_counts(stream: DataFrame, time: str, key: str, late: str = "2 days", width: str = "6 hours") -> DataFrame:
    """Rows and blocked rows per source and collection cycle, rows later than the watermark left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("cycle"), key).agg(F.count("*").alias("n_rows"), F.count_if("blocked").alias("blocked_rows"))
