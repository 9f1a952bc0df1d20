"""The feedback log as a stream: new files of a directory through the batch parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexispark.sources import feedback


def reports(spark: SparkSession, path: str, strict: bool = False, files: int | None = None) -> DataFrame:
    """files bounds how many files a micro-batch takes."""
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    return feedback.parse(reader.text(path), strict)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends parsed reports as Parquet, each exactly once; ends when all present files are read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
