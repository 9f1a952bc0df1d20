"""What the operators of this subpackage share: scratch tables and plain column helpers."""

from __future__ import annotations

import atexit
import ctypes
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Removes shuffle files as soon as the statement that wrote them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SPLITS = "spark.sql.files.minPartitionNum"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder if the session is local, else an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lexispark-")
    return _local[context.applicationId]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the stored tables."""
    path = f"{shared_dir(spark)}/lexispark-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexispark-{name}-{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, text). The number is the row's place, the same whenever the input lists its rows in the same order.

    Files are cut into splits by the cores at hand. Executors come and go, so the
    cores of the first time count for the whole session.
    """
    spark = docs.sparkSession
    if spark.conf.get(_SPLITS, None) is None:
        spark.conf.set(_SPLITS, str(spark.sparkContext.defaultParallelism))
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), "text")


def in_order(docs: DataFrame) -> DataFrame:
    """docs if it is read from files without more than filters and columns between, else a stored copy.

    Only files list their rows in the same order each time and whatever the columns; what
    comes out of a join or another shuffle doesn't. Who numbers rows twice calls this before.
    """
    node = docs._jdf.queryExecution().analyzed()
    plain = node.deterministic()
    while plain and node.children().size():
        plain = node.nodeName() in ("Project", "Filter", "SubqueryAlias")
        node = node.children().apply(0)
    return docs if plain and node.nodeName() == "LogicalRelation" else stored(docs, "rows")


#: A table of ids with at most so many rows may be broadcast: some 10 MB.
MODEST = 1_000_000


def modest(ids: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if it is counted and found small, else joined as Spark sees fit."""
    return F.broadcast(ids) if ids.limit(MODEST + 1).count() <= MODEST else ids


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Deletes a stored table that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for known in [w for w in _written if w[1].split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/")]:
            _written.remove(known)
            remove(*known)


def clear(spark: SparkSession, since: int = 0, but: str | None = None) -> None:
    """Deletes the tables that operators have stored for this session since then: results that are still lazy can't be read after it."""
    for known in [w for w in _written[since:] if w[0] is spark and not w[1].endswith(".zip") and w[1] != but]:
        _written.remove(known)
        remove(*known)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever operators store inside is deleted at the end: write or collect their results before."""
    since = len(_written)
    try:
        yield
    finally:
        clear(spark, since)


def settled(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """Stores what make() gives, and deletes all that was stored on the way there."""
    since = len(_written)
    out = stored(make(), name)
    clear(spark, since, but=_written[-1][1])
    return out


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended first
            return


#: Bytes of an Arrow batch that a Python worker gets at once, unless the session sets its own bound.
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it, and bounds their batches."""
    if spark.conf.get(_ARROW, None) in ("67108864b", "64m"):
        spark.conf.set(_ARROW, f"{ARROW_BYTES}b")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent))
    path = f"{shared_dir(spark)}/lexispark-{uuid.uuid4().hex}.zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(archive.getvalue())
    out.close()
    _written.append((spark, path))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def tidily(run: Callable) -> Callable:
    """run, giving free memory back at the end of each task: workers stay, and others need it."""

    def tidy(batches: Iterator) -> Iterator:
        yield from run(batches)
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return tidy


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that where a text is all ASCII, and faster than translate()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5, the same on every run and in other engines."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
