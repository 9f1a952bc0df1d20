"""The feedback log: `POEM_ID | USERNAME | STATUS | TEXT`, one line a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as t


def parse(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of a column `value` with four parts and a numeric id; others are skipped.

    strict drops a report with empty text too, as trimming the line before
    splitting does.
    """
    value = t.strip(F.col("value")) if strict else F.col("value")
    parts = F.split(value, " \\| ")
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 4)
    poem = F.trim(F.col("p")[0]).try_cast("int")
    return rows.select(poem.alias("poem_id"), F.col("p")[1].alias("username"), F.col("p")[2].alias("status"), t.strip(F.col("p")[3]).alias("interpretation")).where("poem_id is not null")


def of_poem(reports: DataFrame, poem_id: int) -> DataFrame:
    return reports.where(F.col("poem_id") == poem_id)


def lines(reports: DataFrame) -> DataFrame:
    """The lines that a report writes; status must be like or dislike, text is sanitised."""
    good = reports.where(F.col("poem_id").isNotNull() & F.col("status").isin("like", "dislike"))
    return good.select(F.concat_ws(" | ", F.col("poem_id").cast("string"), t.named(F.col("username")), "status", t.sanitized(F.col("interpretation"))).alias("value"))


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return parse(spark.read.text(path), strict)


def append(reports: DataFrame, path: str) -> None:
    lines(reports).write.mode("append").text(path)


def by_status(reports: DataFrame) -> DataFrame:
    return reports.groupBy("status").agg(F.count("*").alias("n"))
