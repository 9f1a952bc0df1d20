"""Quoted CSV in ranges of bytes against a serial scan."""

from __future__ import annotations

import csv
import io
import random
from contextlib import contextmanager
from pathlib import Path

import pytest

from lexispark.plans import index_queries
from lexispark.sources import records, tables

CELLS = tables.strings("a", "b", "c")


@contextmanager
def ranges(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def serial(data: bytes, header=True):
    """Offsets by walking through the bytes."""
    begin = 3 if data.startswith(b"\xef\xbb\xbf") else 0
    out, inside = [begin], False
    for i, b in enumerate(data[begin:], begin):
        if b == 34:
            inside = not inside
        elif b == 10 and not inside and i + 1 < len(data):
            out.append(i + 1)
    return out[1:] if header else out


def rows_of(data: bytes, offsets):
    ends = [*offsets, len(data)][1:]
    return [next(csv.reader(io.StringIO(data[b:e].decode(), newline="")), []) for b, e in zip(offsets, ends, strict=True)]


def table(rng, n):
    parts = ["x", "é中", '"', ",", "\n", "\n\n", " ", "null", "long " * 20, "🙂"]
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["a", "b", "c"])
    for i in range(n):
        w.writerow([str(i), *("".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(2))])
    return out.getvalue().encode()


@pytest.mark.parametrize("size", [150, 1000, 1 << 20])
def test_against_a_serial_scan(spark, tmp_path, size):
    rng = random.Random(size)
    files = {f"{name}.csv": table(rng, n) for name, n in (("a", 60), ("b", 0), ("c", 25))}
    files["c.csv"] = b"\xef\xbb\xbf" + files["c.csv"].removesuffix(b"\n")
    files["d.csv"] = b'a,b,c\r\n1,"x\r\ny",z\r\n2,,\r\n'
    for name, data in files.items():
        Path(tmp_path, name).write_bytes(data)
    want = [(name, o, row) for name, data in sorted(files.items()) for o, row in zip(serial(data), rows_of(data, serial(data)), strict=True)]
    with ranges(spark, size):
        index = sorted(records.record_index(spark, str(tmp_path)).collect(), key=lambda r: r.ordinal)
        read = sorted(records.read(spark, str(tmp_path), CELLS).collect(), key=lambda r: r.ordinal)
    assert [(r.file.rsplit("/", 1)[1], r.ordinal, r.offset) for r in index] == [(name, i, o) for i, (name, o, _) in enumerate(want)]
    assert [(r.ordinal, r.offset) for r in read] == [(i, o) for i, (_, o, _) in enumerate(want)]
    assert [[r.a, r.b, r.c] for r in read] == [row for *_, row in want]


@pytest.mark.parametrize("data", [b"", b"\n", b"a\n\n\nb", b'"open\nand never closed', b'x"y"z\n"a""b\n""c"\n', b"\xef\xbb\xbfa\nb\n", "é\nü".encode()])
def test_odd_files_without_header(spark, tmp_path, data):
    Path(tmp_path, "t.csv").write_bytes(data)
    for size in (4, 100):
        with ranges(spark, size):
            got = sorted((r.ordinal, r.offset) for r in records.record_index(spark, str(tmp_path), header=False).collect())
            texts = sorted((r.ordinal, r.offset, r.value) for r in records.records(spark, str(tmp_path), header=False).collect())
        want = serial(data, header=False) if data else []
        assert got == list(enumerate(want))
        ends = [*want, len(data)][1:]
        assert [(i, o) for i, o, _ in texts] == got
        assert [t for *_, t in texts] == [data[b:e].decode().removesuffix("\n") for b, e in zip(want, ends, strict=True)]


def test_a_record_is_read_without_the_rest(spark, tmp_path):
    data = table(random.Random(5), 200)
    offsets = serial(data)
    file = Path(tmp_path, "t.csv")
    file.write_bytes(data)
    with ranges(spark, 100):
        records.record_index(spark, str(file)).sort("ordinal").write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    for n in (0, 77, 199):
        end = offsets[n + 1] if n < 199 else len(data)
        file.write_bytes(b'"' * offsets[n] + data[offsets[n] : end] + b'"' * (len(data) - end))  # all else is spoilt
        assert [[r.a, r.b, r.c] for r in records.record_at(index, n, CELLS).collect()] == rows_of(data, offsets)[n : n + 1]
    assert records.record_at(index, 200, CELLS).count() == 0


def test_parts_of_a_folder_are_one_file(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f'a "{i}"\n' * (1 + i % 5), "en", "s") for i in range(400)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        path = index_queries._written(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    shelves = [sorted(Path(path.removeprefix("file://")).glob(f"shelf={k}/*.csv")) for k in range(4)]
    assert all(len(parts) > 1 for parts in shelves)  # no task has a whole shelf
    whole = [b"".join(p.read_bytes() for p in parts) for parts in shelves]
    assert all(w.startswith(b'"id","text"\n') for w in whole)
    rows = sorted(records.read(spark, path, index_queries.RECORD, parts=True).collect())
    want = [i for k in range(4) for i in range(k, 400, 4)]
    assert [int(r.id) for r in rows] == want and [r.ordinal for r in rows] == list(range(400))
    assert all(whole[int(r.id) % 4][r.offset :].startswith(f'"{r.id}","a '.encode()) for r in rows)
    at = tables.stored(records.record_index(spark, path, parts=True), "at")
    assert [records.record_at(at, n, index_queries.RECORD).first().id for n in (0, 137, 399)] == [str(want[n]) for n in (0, 137, 399)]
