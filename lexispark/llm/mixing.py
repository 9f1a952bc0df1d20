"""Mixing sources to target weights.

Sizes are words; a source's size is the sum over its documents. The sources, in
code-point order with null last, take the weights in turn. They share a budget
of `share` times all words by weight; a target stops at `cap` times its source's
size and the excess goes to the others by weight until none is above. That fixed
point is min(cap * size, level * weight) with one level for all sources, found
with running sums over the sources ordered by size/weight.

A document's repetition rate is its source's target over its source's size; it
is taken floor(rate) times, and once more if a hash of its doc_id and the seed
falls below the fraction. Reruns therefore agree, whatever the partitioning.

Null text has size 0; a source without words has target 0 and rate 0. Repeated
rows are separate documents that share their draw. An empty table gives an empty
result. Only doc_id, text and source are read; other columns are carried by
`mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table, unit_hash, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = 42


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size); one row per source.

    The aggregate is the only shuffle of the rows. The two running sums go over
    one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    everything = Window.partitionBy()
    first = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    left = weighed.select(
        "*",
        (share * F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("budget"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weights"),
    )
    # In this order the capped sources come first, and the first that isn't capped sets the level for all that follow.
    open_ = F.col("budget") * F.col("weight") < F.col("weights") * F.col("source_size") * cap
    level = F.min_by(F.when(open_, F.col("budget") / F.col("weights")), F.when(open_, F.col("source_size") / F.col("weight"))).over(everything)
    target = F.least(cap * F.col("source_size"), F.coalesce(level * F.col("weight"), cap * F.col("source_size")))
    return left.select("source", "source_size", F.round(target.cast("double"), 6).alias("target"))


def copies(rate: Column, doc_id: Column, seed: int = SEED) -> Column:
    """floor(rate), plus one with the fraction's probability."""
    whole = F.floor(rate)
    return (whole + F.when(unit_hash(seed, doc_id) < rate - whole, 1).otherwise(0)).cast("long")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def mixed_sizes(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sizes, weights, share, cap).withColumnRenamed("source", "of")
    return (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", copies(_rate(), F.col("doc_id"), seed))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = stored(source_targets(sizes, weights, share, cap), "targets").select(
        F.col("source").alias("_of"), "source_size", "target"
    )
    taken = (
        docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_source"), F.col("doc_id").alias("_id"))
        .join(targets, F.col("_source").eqNullSafe(F.col("_of")))
        .withColumn("_n", copies(_rate(), F.col("_id"), seed))
        .where("_n > 0")
    )
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).select("_row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mixed_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (
  SELECT source, source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM s0),
fill AS (
  SELECT source, source_size, weight, 0::DOUBLE AS target, false AS capped, 0 AS round FROM s
  UNION ALL
  SELECT source, source_size, weight,
         least(2.0 * source_size, CASE WHEN capped THEN 2.0 * source_size ELSE share * weight END)::DOUBLE,
         capped OR share * weight >= 2.0 * source_size, round + 1
  FROM (
    SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN 2.0 * source_size END) OVER (), 0))
              / nullif(sum(CASE WHEN NOT capped THEN weight END) OVER (), 0) AS share
    FROM fill) f
  WHERE round < 25),
t AS (SELECT source, source_size, round(target, 6) AS target FROM fill WHERE round = 25),
r AS (
  SELECT doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, (floor(rate) + CASE WHEN ('0x' || md5('42|' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT / 4294967296.0 < rate - floor(rate)
                                THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM r)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM c
"""
