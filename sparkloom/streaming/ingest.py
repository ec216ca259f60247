"""Ingest of pages as a stream: late rows, rows stored again, counts per window.

The source is a folder that files are added to; state is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, schema: object, files_per_batch: int = 8) -> DataFrame:
    """New files of a folder, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_versions(pages: DataFrame, time: str = "crawl_time", late: str = "7 days") -> DataFrame:
    """Each (url, chunk_number, content) once, as long as it is not later than the watermark allows."""
    return pages.withWatermark(time, late).dropDuplicatesWithinWatermark(["url", "chunk_number", "content"])


def arrivals(pages: DataFrame, time: str = "crawl_time", late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Rows and characters per source and window; windows come out once the watermark has passed them."""
    window = F.window(F.col(time), width)
    return pages.withWatermark(time, late).groupBy(window, "source_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("content")).alias("chars"))


def write_replacing(stream: DataFrame, checkpoint: str, store: Callable[[DataFrame, int], None]) -> object:
    """Hands every micro-batch to ``store(batch, number)``; a batch that is given again has the same number."""
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
