"""Resumable enrichment: pending rows through a model, its keywords onto a vocabulary (family E)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark import providers
from lexispark.functions import text as t
from lexispark.operators import review, search
from lexispark.sources.tables import stored_by

#: Chunks of one run at most: each is a job and a commit to the log of its own.
CHUNKS = 32
REPLY = "meaning string, keywords array<string>"


def pending(rows: DataFrame) -> DataFrame:
    """Rows with poem and explanation whose outputs are still blank."""
    return review.pending(search.complete(rows, "poem", "explanation"), ("searchable_explanation", "keywords"))


def replies(rows: DataFrame, call: Callable[[dict], dict], tries: int = 3, tasks: int | None = None) -> DataFrame:
    """(id, meaning, keywords) of each row; a failed row keeps nulls and is pending again next time.

    tasks bounds how many calls run at once.
    """
    asked = rows.select("id", "poem", "explanation")
    return providers.enrich(asked if tasks is None else asked.repartition(tasks, "id"), call, REPLY, tries).select("id", "meaning", "keywords")


LOGGED = "id string, meaning string, keywords array<string>"


def logged(spark: SparkSession, log: str) -> DataFrame:
    """(id, meaning, keywords) of all replies in a log, none if there is no log yet; an id that was logged twice counts once."""
    at = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LOGGED)
    return spark.read.schema(LOGGED).parquet(log).dropDuplicates(["id"])


def run(rows: DataFrame, call: Callable[[dict], dict], log: str, chunk: int = 10_000, most: int | None = None, tries: int = 3, tasks: int | None = None) -> DataFrame:
    """Replies of all pending rows, through a log that only grows; gives what the log holds.

    Rows are dealt by a hash of their id to chunks of about so many, or of more if that made
    more than CHUNKS, and each chunk's replies are committed to the log when it is done. A
    run that dies loses the chunk it was at; the next one asks only for rows that the log
    doesn't have. Rows without a reply aren't logged and are asked again. most bounds the
    chunks of one run. What is left is found once and stored by chunk, so a chunk reads its
    own rows and no others.
    """
    spark = rows.sparkSession
    asked = pending(rows).withColumn("id", F.col("id").cast("string"))
    left = asked.select("id", "poem", "explanation").join(logged(spark, log).select("id"), "id", "left_anti")
    chunks = max(1, min(CHUNKS, -(-left.count() // chunk)))
    dealt = stored_by(left.withColumn("_chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")), "_chunk", "left")
    for n in range(chunks if most is None else min(most, chunks)):
        some = dealt.where(F.col("_chunk") == n).drop("_chunk")
        replies(some, call, tries, tasks).where("meaning is not null or keywords is not null").write.mode("append").parquet(log)
    return logged(spark, log)


def resolved(found: DataFrame, terms: DataFrame, embed: Callable[[Column], Column] = providers.embedding, threshold: float = 0.85, grow: bool = False) -> DataFrame:
    """(id, keywords, new_terms) with each keyword on the vocabulary; terms: keyword, embedding.

    With grow, a keyword that is new is a term for all that come later, in the order of
    ids and of the keywords of each; without, each is held against the given terms only.
    """
    rows = found.select("id", F.posexplode("keywords").alias("place", "name"))
    names = rows.groupBy("name").agg(F.min(F.struct("id", "place")).alias("place")).withColumn("cand_id", F.xxhash64("name")).withColumn("embedding", embed(F.col("name")))
    resolve = search.grow_vocabulary if grow else search.vocabulary_terms
    known = resolve(names.select("cand_id", "place", "name", "embedding"), terms, threshold)
    joined = rows.withColumn("cand_id", F.xxhash64("name")).join(known, "cand_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda s: s["keyword"])
    fresh = F.array_sort(F.collect_set(F.when(F.col("kind") == "new", F.col("keyword"))))
    return joined.groupBy("id").agg(t.join_list(F.array_distinct(ordered)).alias("keywords"), fresh.alias("new_terms"))


def merged(rows: DataFrame, found: DataFrame, keywords: DataFrame) -> DataFrame:
    """All rows with the new outputs where there are any."""
    new = found.select("id", F.col("meaning").alias("_m")).join(keywords.select("id", F.col("keywords").alias("_k")), "id", "left")
    others = [c for c in rows.columns if c not in ("searchable_explanation", "keywords")]
    return rows.join(new, "id", "left").select(*others, F.coalesce("_m", "searchable_explanation").alias("searchable_explanation"), F.coalesce("_k", "keywords").alias("keywords"))
