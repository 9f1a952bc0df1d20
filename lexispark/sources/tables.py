"""Readers and writers: explicit schemas, one CSV dialect, versions swapped in whole."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Quoted cells may hold line breaks; quotes are doubled; blanks in cells are data.
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
CSV_OUT = CSV | {"emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_OUT.pop("multiLine")


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


ENTRIES = strings("id", "Alphabet", "poem", "category", "explanation", "pages", "searchable_explanation", "keywords")
ADVICE = strings("id", "poem", "category", "searchable_explanation", "keywords")
REVIEW = strings("id", "poem", "category", "explanation", "Quyển")
LEARNING_ROWS = strings("topic", "poem_text", "introduction", "interpretation", "blanks")
BOX = "struct<x:double,y:double,w:double,h:double>"
LINES = "pdf string, page_idx int, line_idx int, text string, x double, y double, w double, h double"
NESTED_LINES = "array<struct<text:string,bbox:struct<x:double,y:double,w:double,h:double>>>"
VECTORS = "vec_id long, entry_ord long, facet int, embedding array<float>"
BLANKS = "array<struct<word:string,options:array<string>>>"
LEARNING = f"array<struct<topic:string,poems:array<struct<poem_text:string,blanks:{BLANKS},introduction:string,interpretation:string>>>>"


_local: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a local one only where the session is local. Deleted when the process ends, or by clear()."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _local.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="lexispark-")
        _local[context.applicationId] = shared
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends here, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, column: str, name: str) -> DataFrame:
    """Stored with a folder for each value of a column, of which a filter on it reads no other."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(column).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes what scratch() has named for this session: results that are still lazy can't be read after it."""
    for made in [m for m in _made if m[0] is spark]:
        _made.remove(made)
        remove(*made)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended first
            return


@dataclass(frozen=True)
class Catalog:
    """Where the data of an installation lies, from one root."""

    root: str

    def path(self, kind: str, *names: str) -> str:
        """A path of one kind of data: source, ocr, images, review, enrichment, wiki, indexes, advice or learning."""
        if kind not in ("source", "ocr", "images", "review", "enrichment", "wiki", "indexes", "advice", "learning"):
            raise ValueError(f"no such data: {kind}")
        return "/".join([self.root.rstrip("/"), kind, *names])

    def source(self, name: str) -> str:
        """A scan, whatever folders its name claims."""
        return self.path("source", name.replace("\\", "/").rsplit("/", 1)[-1])

    def ensure(self, spark: SparkSession, path: str) -> str:
        """Creates a folder if it is missing, on whatever store it lies, and gives it back."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
        return path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All cells as text, blanks as empty strings; `null` and `NA` are ordinary text (A1, A2)."""
    return spark.read.options(**CSV).schema(schema).csv(path).fillna("")


def with_ordinal(scan: DataFrame) -> DataFrame:
    """Rows of a file scan numbered in file order, without a sort or a shuffle of them (A4).

    A split's rows are numbered as they are read; what comes before it is the sum of
    the counts of earlier splits, of which the driver holds a list anyway, so the
    counts are broadcast.
    """
    split = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"))
    read = scan.select(*scan.columns, *split, F.monotonically_increasing_id().alias("_at"))
    counts = read.groupBy("_file", "_from").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", "_from", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_before"))
    return read.join(F.broadcast(offsets), ["_file", "_from"]).select(*scan.columns, (F.col("_before") + F.col("_at")).alias("ordinal"))


def row_at(df: DataFrame, ordinal: int) -> DataFrame:
    """Point read (A5): a filter that Parquet statistics can prune."""
    return df.where(F.col("ordinal") == ordinal)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A whole JSON document as one typed column `doc` (A8); with lines, each line is a document, as `write_json` writes them."""
    return spark.read.text(path, wholetext=not lines, **({"lineSep": "\n"} if lines else {})).select(F.from_json("value", schema).alias("doc"))


def write_json(df: DataFrame, path: str, column: str = "doc") -> None:
    """A line for each row's document; a file may hold several."""
    df.select(F.to_json(column).alias("value")).write.mode("overwrite").text(path)


def write_csv(entries: DataFrame, path: str) -> None:
    """Export without rows whose fields are all blank."""
    filled = F.lit(False)
    for name in entries.columns:
        if name != "id":
            filled = filled | (F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != "")
    entries.where(filled).write.mode("overwrite").options(**CSV_OUT).csv(path)


def duplicate_ids(entries: DataFrame) -> DataFrame:
    return entries.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def swap_in(df: DataFrame, path: str) -> None:
    """Writes a folder beside the old and renames it into place, for readers that come later; `versions` has tables that are read meanwhile."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old)]
    fs = at[0].getFileSystem(conf)
    if fs.exists(at[0]):
        fs.rename(at[0], at[2])
    if not fs.rename(at[1], at[0]):
        raise OSError(f"can't rename {new} to {path}")
    fs.delete(at[2], True)


#: Tasks that list folders at most; Spark's own bound (10,000) gives each small folder a task.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "64"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Binary assets by name (A20, A21); contents are read only if selected."""
    key, tasks = LISTING
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), int(tasks))))
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    finally:
        spark.conf.set(key, before)
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1))


#: Folders that written files are dealt to.
FOLDERS = 64


def write_files(df: DataFrame, path: str) -> None:
    """A text file for each row (name, value), found as `<name>.txt`; rows without a value get none.

    Names are unique and contain no slash. On a local (or mounted) file system Hadoop
    starts a process to set the mode of each file and folder that it creates, so there
    tasks write the files themselves, each renamed into place when it is whole: a task
    that runs twice writes the same files. On any other store Spark's writer does it,
    with a folder for each name.
    """
    spark = df.sparkSession
    rows = df.where("value is not null").select("name", "value", F.pmod(F.xxhash64("name"), F.lit(FOLDERS)).cast("int").alias("folder"))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        rows.select("value", F.concat("name", F.lit(".txt")).alias("name")).repartition("name").write.partitionBy("name").text(path)
        return
    fs.mkdirs(at)
    root = fs.makeQualified(at).toUri().getPath()

    def write(batches):
        import os

        for batch in batches:
            for name, value, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                into = f"{root}/folder={folder}"
                os.makedirs(into, exist_ok=True)
                new = f"{into}/.{uuid.uuid4().hex}"
                with open(new, "wb") as out:
                    out.write(value.encode() + b"\n")
                os.replace(new, f"{into}/{name}.txt")
            yield from ()

    rows.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files that write_files has put there."""
    found = files(spark, path, "*.txt")
    text = F.col("content").cast("string")
    return found.select(F.regexp_extract("path", r"([^/=]*)\.txt(?:/[^/]*)?$", 1).alias("name"), F.left(text, F.length(text) - 1).alias("content"))


def pinned_first(listing: DataFrame, name: str) -> DataFrame:
    return listing.orderBy((F.col("name") != name), "name")


def flat_lines(pages: DataFrame) -> DataFrame:
    """Nested recognition output (page_idx, lines) as rows."""
    rows = pages.select("page_idx", F.posexplode("lines").alias("line_idx", "line"))
    return rows.select("page_idx", "line_idx", "line.text", "line.bbox.x", "line.bbox.y", "line.bbox.w", "line.bbox.h")


def page_texts(lines: DataFrame, *page: str) -> DataFrame:
    """Lines back to page text, in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda s: s["text"]), "\n")
    return lines.groupBy(*page).agg(joined.alias("text"))


def labels(codes: Column, names: dict[str, str]) -> Column:
    """Display label of a code, or the code itself."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, codes), codes)
