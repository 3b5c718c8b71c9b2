"""Continuous block building: an extension, with no batch rule changed.

Building blocks needs nothing but a page's own row, so the batch transformation runs on a stream as it is, without
state or watermark; a page file is processed once, and restarts resume from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocks import build_blocks
from ..schemas import OCR_PAGE


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """OCR page files as they arrive in a folder."""
    return spark.readStream.schema(OCR_PAGE).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(path)


def stream_blocks(pages: DataFrame, initial_paths: DataFrame, chapters: dict[str, str], batch_id: str, page_offset: int, to: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the blocks of arriving pages as Parquet; once processes what is there and stops."""
    blocks = build_blocks(pages, initial_paths, chapters, batch_id, page_offset)
    writer = blocks.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def arriving_confidence(lines: DataFrame, time: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Lines and mean score per window of arrival time; rows later than the watermark are left out."""
    return lines.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("lines"), F.avg("score").alias("mean_score")).select("window.start", "window.end", "lines", "mean_score")
