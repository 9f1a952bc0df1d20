"""Nested learning data: flat rows, nested topics, text blocks and back (family G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.sources.tables import scratch


def flatten(nested: DataFrame, key: str, items: str) -> DataFrame:
    """A row for each item, with its place."""
    return nested.select(key, F.posexplode(items).alias("place", "item")).select(key, "place", "item.*")


def regroup(rows: DataFrame, key: str, order: list[str], fields: list[str], name: str = "items") -> DataFrame:
    """Rows of a key as an ordered array of structs."""
    collected = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("item"))))
    return rows.groupBy(key).agg(F.transform(collected, lambda s: s["item"]).alias(name))


def topics(rows: DataFrame) -> DataFrame:
    """CSV rows (ordinal, topic, ...) as topics in first-seen order; topic_place is that order."""
    fields = [c for c in rows.columns if c not in ("ordinal", "topic")]
    nested = rows.groupBy("topic").agg(F.min("ordinal").alias("first"), F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*fields).alias("poem")))).alias("p"))
    return nested.select("topic", F.col("first").alias("topic_place"), F.transform("p", lambda s: s["poem"]).alias("poems")).orderBy("topic_place")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds a running number from 0 in a global order.

    Rows are range-partitioned and sorted once, and written so: a lost executor
    changes no number, and rows that tie keep theirs. A row's number is its place in
    its partition and the counts of those before it, of which there are as many as
    partitions.
    """
    path = scratch(rows.sparkSession, "numbered")
    rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("number", F.col("_before") + within).drop("_part", "_at", "_before")


def blocks(poems: DataFrame) -> DataFrame:
    """Text blocks of numbered poems (number, poem_text, introduction, interpretation)."""
    rule = F.lit("-" * 80)
    body = F.concat_ws(
        "\n", rule, F.concat(F.lit("POEM_ID: "), F.col("number").cast("string")), F.lit("POEM:"), "poem_text", F.lit(""), F.lit("INTRODUCTION:"),
        F.coalesce("introduction", F.lit("")), F.lit(""), F.lit("INTERPRETATION:"), F.coalesce("interpretation", F.lit("")), rule, F.lit(""),
    )
    return poems.select("number", body.alias("value"))


def updates(files: DataFrame) -> DataFrame:
    """(number, introduction, interpretation) from edited text, a file in each row's `value`; the last block of a number counts."""
    found = files.select(F.posexplode(F.split("value", "-{40,}")).alias("place", "block"))
    part = lambda name, upto: F.trim(F.regexp_replace(F.regexp_extract("block", f"(?s)\\n{name}:\\n(.*?){upto}", 1), "(?U)^\\s+|\\s+$", ""))
    rows = found.where(F.col("block").rlike("\\nINTRODUCTION:\\n") & F.col("block").rlike("\\nINTERPRETATION:\\n")).select(
        "place",
        F.regexp_extract("block", "POEM_ID:\\s*(\\d+)", 1).try_cast("long").alias("number"),
        part("INTRODUCTION", "(?=\\nINTERPRETATION:\\n|\\z)").alias("introduction"),
        part("INTERPRETATION", "(?=\\nINTRODUCTION:\\n|\\z)").alias("interpretation"),
    )
    return rows.where("number is not null").groupBy("number").agg(F.max_by("introduction", "place").alias("introduction"), F.max_by("interpretation", "place").alias("interpretation"))


def updated(poems: DataFrame, changes: DataFrame) -> DataFrame:
    """Poems with their updates."""
    new = changes.select("number", F.col("introduction").alias("_i"), F.col("interpretation").alias("_t"))
    fields = [c for c in poems.columns if c not in ("introduction", "interpretation")]
    return poems.join(new, "number", "left").select(*fields, F.coalesce("_i", "introduction").alias("introduction"), F.coalesce("_t", "interpretation").alias("interpretation"))


def options(blanks: DataFrame) -> DataFrame:
    """Options of each blank in random order."""
    return blanks.withColumn("options", F.shuffle(F.array_distinct("options")))
