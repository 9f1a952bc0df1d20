"""Literal search by trigram postings, instead of reading every text.

For each three characters in a row of any field, lower-cased, the index lists the
ordinals of the entries that have them, in blocks of BLOCK ordinals a row: however
frequent a trigram is, no row is large. Rows are sorted by trigram, so a search reads
the row groups of its own trigrams only. An entry with the text has all of its
trigrams; blocks that lack one of them are skipped as a whole, the others intersect
their lists, and candidates are verified on their fields. A text of less than three
characters has no trigram and is looked for in all entries.

Entries have an integer `ordinal`, each once. Null fields are never found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators import browse

BLOCK = 1024


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, in a time in proportion to its length."""
    letters = F.array(F.split(text, ""))
    of = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda i: F.concat(F.element_at(c, i), F.element_at(c, i + 1), F.element_at(c, i + 2)))
    return F.when(F.length(text) >= 3, F.array_distinct(F.flatten(F.transform(letters, of)))).otherwise(F.array().cast("array<string>"))


def postings(entries: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(gram, block, ordinals): the index, to be stored sorted by gram."""
    grams = F.array_distinct(F.flatten(F.array(*[trigrams(F.lower(F.coalesce(F.col(f).cast("string"), F.lit("")))) for f in fields])))
    rows = entries.select("ordinal", F.explode(grams).alias("gram"))
    return rows.groupBy("gram", F.floor(F.col("ordinal") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list("ordinal")).alias("ordinals"))


def write(entries: DataFrame, fields: tuple[str, ...], path: str) -> None:
    postings(entries, fields).repartitionByRange("gram").sortWithinPartitions("gram", "block").write.option("compression", "zstd").parquet(path)


def candidates(index: DataFrame, query: str) -> DataFrame:
    """The ordinals of the entries that have all trigrams of a text of three characters at least."""
    wanted = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    hits = index.where(F.col("gram").isin(wanted)).groupBy("block").agg(F.collect_list("ordinals").alias("lists")).where(F.size("lists") == len(wanted))
    both = F.aggregate(F.slice("lists", 2, len(wanted)), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return hits.select(F.explode(both).alias("ordinal"))


def literal(entries: DataFrame, index: DataFrame, query: str, fields: tuple[str, ...], limit: int = 10) -> DataFrame:
    """The first entries in row order with the text in any field: the rows of `browse.literal`, through the index."""
    wanted = query.lower().strip()
    if len(wanted) < 3:
        return browse.literal(entries, query, fields, limit)
    found = entries.join(candidates(index, wanted), "ordinal", "left_semi")
    has = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(f), F.lit(wanted)), F.lit(False)) for f in fields])
    return found.where(has).orderBy("ordinal").limit(limit)
