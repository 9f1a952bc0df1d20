"""Token counts with a digest cache.

A count depends on the content and on the tokenizer, so the cache is a Parquet
folder of (tokenizer, content, n_tokens): the SHA-256 of the tokenizer file, by
which the folder is partitioned, and the SHA-256 of the normalised text. Null and
empty text are one content; a caller may pass a further normalisation, but only
one that changes no text's ids.

* Digests of all rows are stored without their texts and reduced to distinct
  contents. Those that the cache doesn't hold are the misses; of each, the row
  with the smallest doc_id lends its text (null last; of repeated rows any).
* Texts of misses, and no others, reach the tokenizer: texts are dealt by digest
  and doc_id and meet the list of misses there, so that copies, however many,
  don't come to one task. Where the misses are few beside a large input, Spark
  puts its own runtime Bloom filter before that shuffle.
* The new counts are appended to the cache, and all rows are joined with it. Two
  runs may append one digest; it counts once when it is read. Digests that hold
  more than a `support` share of the rows meet their counts by a broadcast of
  1/support rows at most; the rest goes through an ordinary shuffle.

The tokenizers library counts. A text is the sum of its pieces under the file's
own splitting, so a worker asks the library for each distinct piece once, for
CACHE pieces at most. That holds for characters on whose class the library's
pattern and Python's agree (see SAFE); a text with any other character, or with
the string of a special token, goes to the library whole.

Repeated rows each get their result; only doc_id and text are read; an empty
table gives an empty result and leaves the cache as it is. A lost executor costs
the tasks that it ran: what a step has finished lies in the shared folder.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, ship, stored, table, tidily

LIMIT = 512
#: A digest with a larger share of the rows meets its count by broadcast.
SUPPORT = 1 / 512
#: Pieces that a worker remembers.
CACHE = 300_000

#: Fixed value: how the file's kind of pre-tokenizer splits a text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts of these characters alone are split here: ASCII without the four separators, Latin, Cyrillic, common punctuation, kana and Han.
SAFE = re.compile("[\x00-\x1b\x20-ɏЀ-ҁҊ-ӿ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥]*")

CACHE_SCHEMA = "content string, n_tokens long, tokenizer string"


class PieceCounter:
    """Token counts of texts, as the library gives them for one tokenizer file."""

    def __init__(self, spec: str, limit: int = CACHE):
        from tokenizers import Tokenizer

        told = json.loads(spec)
        before = told.get("pre_tokenizer") or {}
        #: Whether pieces may be counted one by one.
        self.apart = before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space") and told.get("normalizer") is None
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t["content"] for t in told.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.limit, self.known = limit, {}

    def _library(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, text: str) -> int:
        if not self.apart or not SAFE.fullmatch(text) or self.special and self.special.search(text):
            return self._library([text])[0]
        pieces = PIECES.findall(text)
        try:
            return sum(map(self.known.__getitem__, pieces))
        except KeyError:
            pass
        if len(self.known) > self.limit:
            self.known.clear()
        new = list(set(pieces).difference(self.known))
        self.known.update(zip(new, self._library(new), strict=True))
        return sum(map(self.known.__getitem__, pieces))


_loaded: dict[int, PieceCounter] = {}


def _counter(spec: str) -> PieceCounter:
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceCounter(spec)
    return _loaded[key]


def content_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) that the cache holds for a tokenizer, each content once; none if there is no cache yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "content string, n_tokens long")
    held = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return held.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(texts: DataFrame, spec: str) -> DataFrame:
    """(content, n_tokens) of rows (content, text)."""
    held = texts.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(held.value)
        for batch in batches:
            counts = [counter.count(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(tidily(run), "content string, n_tokens long")


def _misses(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(content, lender, copies): the contents that aren't held, the doc_id of the row that lends its text, and how many rows have both."""
    rows = asked.groupBy("content", "doc_id").agg(F.count("*").alias("copies"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copies"))
    return rows.groupBy("content").agg(least.alias("least")).join(held, "content", "left_anti").select("content", F.col("least.doc_id").alias("lender"), "least.copies")


def count_tokens(docs: DataFrame, path: str, cache: str, normalise: Callable[[Column], Column] | None = None, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8) and n_tokens. New counts have been appended to the cache when this returns.

    path: a file of the tokenizers library; cache: a folder that all executors share.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    tokenizer = hashlib.sha256(spec.encode()).hexdigest()
    whole = F.coalesce("text", F.lit(""))
    text = normalise(whole) if normalise else whole
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    rows = rows.withColumn("content", content_digest(F.col("text")))
    asked = stored(rows.select("doc_id", "n_bytes", "content"), "asked")

    misses = stored(_misses(asked, read_cache(spark, cache, tokenizer)), "misses")
    if not misses.isEmpty():
        wanted = misses.select(F.col("content").alias("_content"), F.col("lender").alias("_lender"), "copies").hint("shuffle_hash")
        same = (F.col("content") == F.col("_content")) & F.col("doc_id").eqNullSafe(F.col("_lender"))
        lent = rows.select("content", "doc_id", "text").join(wanted, same)
        repeated = lent.where("copies > 1").groupBy("content").agg(F.min("text").alias("text"))
        texts = lent.where("copies = 1").select("content", "text").unionByName(repeated)
        counted = _encoded(texts, spec).withColumn("tokenizer", F.lit(tokenizer))
        counted.write.mode("append").partitionBy("tokenizer").option("compression", "zstd").parquet(cache)

    counts = read_cache(spark, cache, tokenizer)
    frequent = stored(asked.stat.freqItems(["content"], support).select(F.explode("content_freqItems").alias("content")), "frequent")
    heavy = stored(counts.join(F.broadcast(frequent), "content", "left_semi"), "frequent_counts")
    rest = asked.join(F.broadcast(frequent), "content", "left_anti").join(counts.hint("shuffle_hash"), "content")
    return asked.join(F.broadcast(heavy), "content").unionByName(rest).select("doc_id", "n_bytes", "n_tokens")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents, through a cache that starts empty."""
    found = count_tokens(table(spark, sf_dir, "documents"), vocabulary(), scratch_path(spark, "counts"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
