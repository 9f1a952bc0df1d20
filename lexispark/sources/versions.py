"""Versions of a table: complete or not there.

A table is a folder with a subfolder for each version and one for pointers. A version is
written whole before its pointer, a small numbered file, is created; creating fails if
the file exists, on every store that Hadoop knows, so two writers never take one number.
Readers take the greatest pointer that names a complete version. There is no rename, no
moment without a version, and a writer that dies leaves the version before it as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_POINTERS = "_pointers"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, at = _fs(spark, f"{root}/{_POINTERS}")
    if not fs.exists(at):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit())


def _named(spark: SparkSession, root: str, number: int) -> str | None:
    """The folder that a pointer names, if that version is complete."""
    fs, at = _fs(spark, f"{root}/{_POINTERS}/{number:012}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        name = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
    done = _fs(spark, f"{root}/{name}/_SUCCESS")[1]
    return name if name and fs.exists(done) else None


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all complete versions, oldest first."""
    return [n for n in _pointers(spark, root) if _named(spark, root, n)]


def latest(spark: SparkSession, root: str) -> int | None:
    return next((n for n in reversed(_pointers(spark, root)) if _named(spark, root, n)), None)


def _write(df: DataFrame, root: str) -> str:
    name = f"v-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{root}/{name}")
    return name


def _point(spark: SparkSession, root: str, name: str, number: int) -> bool:
    """Creates the pointer, or tells that another writer has."""
    fs, at = _fs(spark, f"{root}/{_POINTERS}/{number:012}")
    fs.mkdirs(at.getParent())
    if fs.exists(at):
        return False
    try:
        stream = fs.create(at, False)
    except Exception:  # created by another meanwhile; anything else shows when it is tried again
        if fs.exists(at):
            return False
        raise
    stream.write(name.encode())
    stream.close()
    return True


def publish(df: DataFrame, root: str) -> int:
    """A new version, which readers see at once and in whole; its number. Versions that are read stay until prune()."""
    spark, name = df.sparkSession, _write(df, root)
    number = max(_pointers(spark, root), default=0) + 1
    while not _point(spark, root, name, number):
        number += 1
    return number


def bootstrap(df: DataFrame, root: str) -> bool:
    """The first version, unless there is one: of several sessions that start at once exactly one succeeds."""
    spark = df.sparkSession
    if latest(spark, root) is not None:
        return False
    name = _write(df, root)
    if _point(spark, root, name, 1):
        return True
    fs, at = _fs(spark, f"{root}/{name}")
    fs.delete(at, True)
    return False


def read(spark: SparkSession, root: str, version: int | None = None, schema: str | None = None) -> DataFrame:
    """The latest version, or the one of that number: what is read stays the same whatever is published meanwhile."""
    number = latest(spark, root) if version is None else version
    name = None if number is None else _named(spark, root, number)
    if name is None:
        raise FileNotFoundError(f"no version {'' if number is None else number} at {root}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/{name}")


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the latest complete versions; first their pointers, so that no reader begins with one."""
    for number in versions(spark, root)[: -keep or None]:
        name = _named(spark, root, number)
        for path in (f"{root}/{_POINTERS}/{number:012}", f"{root}/{name}"):
            fs, at = _fs(spark, path)
            fs.delete(at, True)
