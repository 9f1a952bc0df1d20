"""Quoted CSV read in parallel, and by record: where each record of a file begins (A4, A5).

Spark reads a CSV with line breaks in its cells one file a task. Here files are read
as lines, which Spark cuts into ranges of bytes, and lines are put together to records:

* Each range sums up its bytes and its quotes, and counts the records that begin in it,
  once as if it began outside quotes and once inside. Sums over the ranges before it
  tell which of both holds, and at what byte and what record the range begins. There is
  one row for each range, of which the driver holds a list anyway.
* A second pass counts on from there, line by line. A line begins a record if the
  quotes before it are even. No line is shuffled or sorted for it.
* Records that end in the range where they begin are ready; pieces of all others, two a
  range at most unless a record is longer than a range, meet by record.

Quotes toggle wherever they stand, as RFC 4180's doubled quotes allow. Lines end with a
line feed; a carriage return before it belongs to the record. An empty line is a record.
Ranges are as large as spark.sql.files.maxPartitionBytes says and may be smaller than a
line. Files are in the order of their paths; with `header` the first record of each is
none. A byte order mark belongs to no record. Compressed files have no offsets.

With `parts` the files of a folder are the parts of one, cut between records, as tasks write
them side by side: the header is that of the first part, and offsets of `read` count through
all of them. `record_index` gives the part in which a record lies and its offset there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FROM_CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"}
_TALLY = "file string, block long, bytes long, quotes long, even long, odd long"
_INDEX = "file string, ordinal long, offset long"
_PIECE = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("offset", pa.int64()), ("whole", pa.bool_()), ("value", pa.string())])
_PIECES = "file string, ordinal long, offset long, whole boolean, value string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block (where the line's range begins), size (of the file), bytes (with the line's end) and quotes."""
    text = spark.read.option("lineSep", "\n").text(path)
    size = F.octet_length("value")
    quotes = size - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    meta = [F.col(f"_metadata.{m}").alias(a) for m, a in (("file_path", "file"), ("file_block_start", "block"), ("file_size", "size"))]
    return text.select("value", *meta, (size + 1).cast("long").alias("bytes"), quotes.cast("long").alias("quotes"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], slice]]:
    """The ranges that follow one another in a batch."""
    file = pc.dictionary_encode(batch.column("file"))
    key, block = file.indices.to_numpy(), batch.column("block").to_numpy()
    at = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
    ends = [*at.tolist(), len(batch)]
    for begin, end in zip([0, *ends[:-1]], ends, strict=True):
        if end > begin:
            yield (file.dictionary[int(key[begin])].as_py(), int(block[begin])), slice(begin, end)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, sums = None, [0, 0, 0, 0]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(("file", "block", "bytes", "quotes", "even", "odd"), ([x] for x in (*held, *sums)), strict=True)))

    for batch in batches:
        size, quotes = batch.column("bytes").to_numpy(), batch.column("quotes").to_numpy()
        for range_, rows in _runs(batch):
            if range_ != held:
                if held:
                    yield out()
                held, sums = range_, [0, 0, 0, 0]
            inside = (np.cumsum(quotes[rows]) - quotes[rows] + sums[1]) & 1
            sums = [sums[0] + int(size[rows].sum()), sums[1] + int(quotes[rows].sum()), sums[2] + int((inside == 0).sum()), sums[3] + int(inside.sum())]
    if held:
        yield out()


def _before(lines: DataFrame, header: bool, parts: bool) -> DataFrame:
    """(file, block, at, seen, first, origin, base): the byte, the quotes and the record with which each range begins, the file's first record and the bytes of the parts before it; one row a range."""
    tally = lines.select("file", "block", "bytes", "quotes").mapInArrow(_tally, _TALLY)
    sizes = lines.groupBy("file").agg(F.first("size").alias("size"))
    folder = F.regexp_replace("file", "/[^/]*$", "") if parts else F.col("file")
    ahead = Window.partitionBy(folder).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("size").over(ahead), F.lit(0).cast("long")))
    of_file = Window.partitionBy("file")
    earlier = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    # A mark is not among the lines' bytes; a file's last line may lack its end.
    mark = F.when((F.sum("bytes").over(of_file) - F.col("size")).isin(-3, -2), 3).otherwise(0)
    summed = tally.join(sizes, "file").select(
        "file", "block", "even", "odd", "base", (F.coalesce(F.sum("bytes").over(earlier), none) + mark).alias("at"), F.coalesce(F.sum("quotes").over(earlier), none).alias("seen")
    )
    heading = F.when((F.col("block") == 0) & (F.col("base") == 0), F.lit(int(header))).otherwise(0)
    begun = F.when(F.col("seen") % 2 == 0, F.col("even")).otherwise(F.col("odd")) - heading
    every = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = summed.select("file", "block", "at", "seen", "base", F.coalesce(F.sum(begun).over(every), none).alias("first"))
    return placed.select("file", "block", "at", "seen", (F.col("first") - heading).alias("first"), F.min("first").over(of_file).alias("origin"), "base")


def _counted(spark: SparkSession, path: str, header: bool, parts: bool) -> DataFrame:
    """Lines with what their range begins with. The list of ranges is broadcast: the driver has it for each scan."""
    lines = _lines(spark, path)
    return lines.join(F.broadcast(_before(lines, header, parts)), ["file", "block"])


class _Place:
    """Counts on through the lines of a task."""

    def __init__(self) -> None:
        self.range: tuple[str, int] | None = None
        self.at = self.seen = self.next = 0

    def through(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(file, rows, whether the range is new, offset of each line, whether it begins a record, ends one, the record's ordinal, whether that is no header)."""
        size, quotes, at, seen, first, origin = (batch.column(c).to_numpy() for c in ("bytes", "quotes", "at", "seen", "first", "origin"))
        for range_, rows in _runs(batch):
            new = range_ != self.range
            if new:
                self.range, self.at, self.seen, self.next = range_, int(at[rows.start]), int(seen[rows.start]), int(first[rows.start])
            offset = np.cumsum(size[rows]) - size[rows] + self.at
            after = np.cumsum(quotes[rows]) + self.seen
            begins, ends = (after - quotes[rows]) % 2 == 0, after % 2 == 0
            ordinal = np.cumsum(begins) + self.next - 1
            yield range_[0], rows, new, offset, begins, ends, ordinal, ordinal >= origin[rows]
            self.at, self.seen, self.next = self.at + int(size[rows].sum()), int(after[-1]), int(ordinal[-1]) + 1


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = _Place()
    for batch in batches:
        for file, _, _, offset, begins, _, ordinal, kept in place.through(batch):
            begins = begins & kept
            yield pa.RecordBatch.from_arrays([pa.array([file] * int(begins.sum()), pa.string()), pa.array(ordinal[begins]), pa.array(offset[begins])], ["file", "ordinal", "offset"])


def record_index(spark: SparkSession, path: str, header: bool = True, parts: bool = False) -> DataFrame:
    """(file, ordinal, offset): the byte at which each record begins, numbered from 0 through all files (A4)."""
    return _counted(spark, path, header, parts).select("file", "block", "bytes", "quotes", "at", "seen", "first", "origin").mapInArrow(_offsets, _INDEX)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and pieces of those that begin or end in another range, each with the offset of its first line.

    Lines that are records stay in their Arrow arrays; only the lines of longer ones are put together.
    """
    place = _Place()
    open_: list | None = None  # file, ordinal, offset, whether the record begins here, lines

    def closed(ended: bool) -> dict:
        file, ordinal, offset, begun, lines = open_
        return {"file": file, "ordinal": ordinal, "offset": offset, "whole": begun and ended, "value": "\n".join(lines)}

    for batch in batches:
        made = []
        for file, rows, new, offset, begins, ends, ordinal, kept in place.through(batch):
            if new and open_:
                made.append(closed(False))
                open_ = None
            value = batch.column("value").slice(rows.start, rows.stop - rows.start)
            alone = begins & ends & kept
            n = int(alone.sum())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(ordinal[alone]), pa.array(offset[alone]), pa.array([True] * n), value.filter(pa.array(alone))], schema=_PIECE)
            for i in np.flatnonzero(kept & ~alone).tolist():
                if open_ is None:
                    open_ = [file, int(ordinal[i]), int(offset[i]), bool(begins[i]), []]
                open_[4].append(value[i].as_py())
                if ends[i]:
                    made.append(closed(True))
                    open_ = None
        if made:
            yield pa.RecordBatch.from_pylist(made, _PIECE)
    if open_:
        yield pa.RecordBatch.from_pylist([closed(False)], _PIECE)


def records(spark: SparkSession, path: str, header: bool = True, parts: bool = False) -> DataFrame:
    """(file, ordinal, offset, value): the text of each record, in parallel within a file, too."""
    pieces = _counted(spark, path, header, parts).withColumn("at", F.col("at") + F.col("base")).mapInArrow(_pieces, _PIECES)
    ready = pieces.where("whole").select("file", "ordinal", "offset", "value")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda p: p["value"])
    cut = pieces.where("not whole").groupBy("file", "ordinal").agg(F.min("offset").alias("offset"), F.array_join(ordered, "\n").alias("value"))
    return ready.unionByName(cut)


def _cells(value: DataFrame, schema: T.StructType) -> DataFrame:
    """The cells of a column `value`, beside the other columns; blank ones are empty strings."""
    others = [c for c in value.columns if c != "value"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return value.select(*others, F.from_csv("value", fields, FROM_CSV).alias("_cells")).select(*others, "_cells.*").fillna("", [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)])


def read(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, parts: bool = False) -> DataFrame:
    """ordinal, offset and the cells of each record."""
    return _cells(records(spark, path, header, parts).select("ordinal", "offset", F.regexp_replace("value", "\\r\\z", "").alias("value")), schema)


def record_at(index: DataFrame, ordinal: int, schema: T.StructType) -> DataFrame:
    """The cells of one record (A5), none if there is no such record. index: a stored record_index.

    Two rows of the index, which its statistics find, say where the record lies; the file is
    opened there and nothing before or behind it is read.
    """
    spark = index.sparkSession
    found = {r["ordinal"]: r for r in index.where(F.col("ordinal").isin(ordinal, ordinal + 1)).collect()}
    if ordinal not in found:
        return _cells(spark.createDataFrame([], "ordinal long, value string"), schema)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, after = found[ordinal], found.get(ordinal + 1)
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(at["file"]))
    fs = path.getFileSystem(conf)
    end = after["offset"] if after and after["file"] == at["file"] else fs.getFileStatus(path).getLen()
    stream = fs.open(path)
    try:
        stream.seek(at["offset"])
        held = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, end - at["offset"]))
    finally:
        stream.close()
    text = held.decode("utf-8", "replace").removesuffix("\n").removesuffix("\r")
    return _cells(spark.createDataFrame([(ordinal, text)], "ordinal long, value string"), schema)
