"""Faceted, sorted, paginated browsing of entries (family C)."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as t

#: An escape character that no pattern has: %, _ and \ in a search keep the meaning they have without one.
NO_ESCAPE = "\x01"


def with_letters(entries: DataFrame) -> DataFrame:
    """Adds the computed letter facet; done once at ingest."""
    return entries.withColumn("base_alphabet", t.base_alphabet(F.col("Alphabet")))


def matching(entries: DataFrame, alphabet: str = "", category: str = "All", search: str = "", compat: str = "unicode") -> DataFrame:
    """Search overrides the letter (B1, B2, B3); compat="ascii" folds A-Z of the column only."""
    found = entries
    if search:
        column = F.lower("poem") if compat == "unicode" else F.translate("poem", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        found = found.where(F.like(column, F.lit(f"%{search.lower()}%"), F.lit(NO_ESCAPE)))
    elif alphabet:
        found = found.where(F.col("base_alphabet") == alphabet)
    if category not in ("", "All"):
        found = found.where(F.col("category") == category)
    return found


def page(found: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page in order of letter, poem and id (K7): a top-k with offset, no full sort."""
    if number < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return found.orderBy("Alphabet", "poem", "id").offset((number - 1) * size).limit(size)


ORDER = ("Alphabet", "poem", "id")
#: Ranges of a page directory at most; their counts are held by the driver.
RANGES = 10_000


@dataclass(frozen=True)
class Pages:
    """Entries sorted once, so that any page reads one range or two, however far back it is (K7).

    rows are stored in ranges of the order (a folder each); starts[i] is how many rows lie
    before range i. `browse.page` sorts all that precedes a page, each time.
    """

    rows: DataFrame
    starts: list[int]

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        if number < 1 or size < 1:
            raise ValueError("page and size start at 1")
        begin, end = (number - 1) * size, number * size
        first = bisect_right(self.starts, begin) - 1
        last = bisect_right(self.starts, end - 1) - 1
        some = self.rows.where(F.col("_range").between(first, last)).drop("_range")
        return some.orderBy(*ORDER).offset(begin - self.starts[first]).limit(size)

    def after(self, row: dict, size: int = 20) -> DataFrame:
        """The rows behind one that has been shown, by its own values: no counting, and no page is shown twice if rows are added."""
        later, equal = F.lit(False), F.lit(True)
        for c in ORDER:
            value = F.lit(row[c]).cast(self.rows.schema[c].dataType)
            greater = F.col(c).isNotNull() if row[c] is None else F.coalesce(F.col(c) > value, F.lit(False))
            later, equal = later | (equal & greater), equal & F.col(c).eqNullSafe(value)
        return self.rows.where(later).drop("_range").orderBy(*ORDER).limit(size)

    @property
    def total(self) -> int:
        return self.starts[-1]


def write_pages(found: DataFrame, path: str, ranges: int | None = None) -> None:
    """Stores entries in ranges of their order: one sort, and one folder for each range."""
    parts = min(RANGES, ranges or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = found.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    ranged.withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").option("compression", "zstd").parquet(path)


def read_pages(spark: SparkSession, path: str) -> Pages:
    """The directory: counts come from the files' footers."""
    rows = spark.read.parquet(path)
    if "_range" not in rows.columns:  # no rows, no folders
        rows = rows.withColumn("_range", F.lit(0))
    counts = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    return Pages(rows, [0, *accumulate(counts.get(i, 0) for i in range(max(counts, default=-1) + 1))])


def totals(found: DataFrame, size: int = 20) -> DataFrame:
    """Rows and pages."""
    return found.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("total_pages"))


def facets(entries: DataFrame, *by: str) -> DataFrame:
    return entries.groupBy(*by).agg(F.count("*").alias("n"))


def literal(entries: DataFrame, query: str, fields: tuple[str, ...], limit: int = 10) -> DataFrame:
    """The first entries in row order with the text in any field."""
    wanted = query.lower().strip()
    found = F.lit(False)
    for field in fields:
        found = found | F.coalesce(F.contains(F.lower(field), F.lit(wanted)), F.lit(False))
    return entries.where(found).orderBy("ordinal").limit(limit)
