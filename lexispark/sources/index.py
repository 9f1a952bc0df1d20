"""Vector indexes as Parquet: rows vec_id, entry_ord, facet, embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.sources import versions
from lexispark.sources.tables import VECTORS


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return versions.read(spark, path, version, VECTORS)


def write(vectors: DataFrame, path: str) -> int:
    """Sorted by entry, so that row-group statistics prune lookups; a new version, in whole."""
    return versions.publish(vectors.select("vec_id", "entry_ord", "facet", vectors.embedding.cast("array<float>").alias("embedding")).sortWithinPartitions("entry_ord", "facet"), path)
