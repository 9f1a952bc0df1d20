"""Exact dedup with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Misra-Gries counters (Spark's `freqItems`) name every digest that may hold more
than a `support` share of the rows: 1/support candidates at most. Their counts
and winners are verified exactly and broadcast, so that rows of frequent digests
are settled where they are read. All other digests go through an ordinary
shuffle, in which no group can hold more than that share of the rows.

Of equal texts the row with the largest doc_id stays (null doc_ids rank below
all others); of repeated rows with one doc_id and text exactly one stays. Only
doc_id and text are read, so other columns may have any name. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, in_order, modest, numbered, stored

#: A digest with a larger share of the rows counts as heavy; the broadcast has 1/SUPPORT rows at most.
SUPPORT = 1 / 512


def text_digest(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def heavy_winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of the digests with more than support of the rows.

    digests: (doc_id, row_id, digest). At most 1/support rows, each about 100 bytes.
    """
    candidates = digests.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    counted = (
        digests.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count("*").alias("group_size"))
    )
    total = digests.agg(F.count("*").alias("total"))
    return (
        counted.join(F.broadcast(total), F.col("group_size") > F.col("total") * support)
        .select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row_id").alias("keep_row"), "group_size")
    )


def _digests(docs: DataFrame) -> DataFrame:
    return stored(numbered(docs).select("doc_id", "row_id", text_digest(F.col("text")).alias("digest")), "digests")


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = _digests(docs)
    heavy = stored(heavy_winners(digests, support), "heavy")
    settled = digests.join(F.broadcast(heavy), "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256")
    )
    group = Window.partitionBy("digest")
    last = group.orderBy(F.desc_nulls_last("doc_id"), F.desc("row_id"))
    rest = (
        digests.join(F.broadcast(heavy), "digest", "left_anti")
        .withColumn("place", F.row_number().over(last))
        .withColumn("keep_id", F.first("doc_id").over(last))
        .select("doc_id", "keep_id", F.count("*").over(group).alias("group_size"), (F.col("place") == 1).alias("kept"), F.col("digest").alias("text_sha256"))
    )
    return settled.unionByName(rest)


def drop_exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Texts are hashed once and not shuffled for it: digests decide, and the rows that
    lose are taken out by their number (by a broadcast of those numbers while they
    are few, counted). An input that isn't read from files as it is gets stored first,
    so that its rows have the same numbers when they are looked at again.
    """
    docs = in_order(docs)
    digests = _digests(docs)
    heavy = stored(heavy_winners(digests, support), "heavy")
    beaten = digests.join(F.broadcast(heavy), "digest").where("row_id <> keep_row").select("row_id")
    last = Window.partitionBy("digest").orderBy(F.desc_nulls_last("doc_id"), F.desc("row_id"))
    rest = digests.join(F.broadcast(heavy), "digest", "left_anti").withColumn("place", F.row_number().over(last))
    lost = stored(beaten.unionByName(rest.where("place > 1").select("row_id")), "lost").withColumnRenamed("row_id", "_lost")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_id"))
    return rows.join(modest(lost), F.col("_id") == F.col("_lost"), "left_anti").select("_row.*")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents."""
    from .common import table

    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
