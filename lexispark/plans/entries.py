"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators import browse
from lexispark.sources.tables import read_table as read


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries with letters."""
    docs = documents(spark, sf_dir)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ordinal"), F.substring("text", 1, 1).alias("Alphabet"), F.col("text").alias("poem"), F.col("lang").alias("category"), "source")
    return browse.with_letters(rows)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors an entry."""
    found = read(spark, sf_dir, "embeddings")
    return found.select("vec_id", F.floor(F.col("vec_id") / 3).alias("entry_ord"), (F.col("vec_id") % 3).cast("int").alias("facet"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One vector, as a request would bring it."""
    return list(read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries whose names are their keywords."""
    parts = read(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").alias("ordinal"), F.split("p_name", " ").alias("keywords"), F.col("p_brand").alias("category"), F.col("p_type").alias("poem"))


def keyword_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted keywords, each with the embedding of its place."""
    from pyspark.sql import Window

    from lexispark.operators import search

    words = search.keyword_rows(tagged(spark, sf_dir)).select("keyword").distinct()
    placed = words.select("keyword", (F.row_number().over(Window.orderBy("keyword")) - 1).cast("long").alias("vec_id"))  # a vocabulary
    return placed.join(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents on an invented page; a short line counts as a heading."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_idx", "text"))
    n, i = F.length("text"), F.col("line_idx")
    return rows.select(
        "page", "line_idx", "text", (((n % 3) * 30 + 50) / 1000.0).alias("x"), ((i * 20 + (n % 9) * 2) / 1000.0).alias("y"),
        (n % 700 / 1000.0).alias("w"), F.lit(0.01).alias("h"), (n < 25).alias("heading"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")
