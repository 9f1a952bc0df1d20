"""Media columns: content-defined chunks, each stored once.

A text's payload is its UTF-8 padded with zero bytes to a positive multiple of 64:
8-bit samples. A rolling gear hash cuts it: each byte shifts the hash and adds a
random word, so that the last 32 bytes decide, and a chunk ends where the top
CUT_BITS bits are zero, between SMALLEST and LARGEST bytes. Equal passages thus
give equal chunks wherever they stand. Every text is cut and hashed once.

A document's stored form is its manifest (a header, then digest and size of each
chunk, in order) followed by its chunks' samples as they are, one byte a sample.
Both exist as bytes in the written table: the manifest in the document's row, a
chunk's samples in the row of the document that owns it. Digests that occur more
than once are found by Spark from the manifests; the first occurrence owns the
chunk, and joins tell every row which of its chunks others own. Only then are
samples written, each distinct chunk once; Parquet compresses them.

Reading sends the chunks that others own to the rows that name them by a join on
the digest (chunks that more than a 1/HEAVY share of all chunks repeat are
broadcast: HEAVY of them at most, LARGEST bytes each), sorts each document's
chunks, checks every digest, size and place, and fails loudly on any that is
wrong. Documents that own all their chunks are read where they stand.

Null text counts as empty: 64 zero bytes. Repeated rows are kept apart by row_id
and share all chunks. A payload needs memory for itself; hashing goes in blocks.
Only doc_id and text are read; an empty table gives an empty store and result.
The input may be read once only.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MODEST, numbered, release, ship, stored, table, tidily

UNIT = 64
SMALLEST, CUT_BITS, LARGEST = 1024, 11, 16384
#: Bytes that the hash covers.
SPAN = 32
BLOCK = 4 << 20
HEAVY = 64
MAGIC = b"CDC1"
#: The manifest's header (bytes of the text, chunks) and entries (digest, size).
HEADER, ENTRY = struct.Struct("<4sQI"), struct.Struct("<32sI")
#: Whose a chunk is: the row's alone, another row's, or the row's and named by others.
OWN, FOREIGN, SHARED = 0, 1, 2
#: The gear table: a word for each byte value, from SHA-256 of the value.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, over the SPAN bytes up to it: sums of doubled widths."""
    h, width = GEAR[data], 1
    while width < SPAN:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def cuts(payload: bytes) -> list[int]:
    """The end of each chunk."""
    data = np.frombuffer(payload, np.uint8)
    marks = []
    for at in range(0, len(data), BLOCK):
        begin = max(0, at - SPAN)
        h = gear(data[begin : at + BLOCK])[at - begin :]
        marks.append(np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + at + 1)
    marks = np.concatenate(marks)
    ends, at = [], 0
    while len(data) - at > SMALLEST:
        i = int(np.searchsorted(marks, at + SMALLEST))
        at = min(int(marks[i]) if i < len(marks) else len(data), at + LARGEST, len(data))
        ends.append(at)
    if at < len(data):
        ends.append(len(data))
    return ends


def chunks_of(payload: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(digest, chunk) in order."""
    begin = 0
    for end in cuts(payload):
        chunk = payload[begin:end]
        yield hashlib.sha256(chunk).digest(), chunk
        begin = end


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about so many bytes."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if n > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def manifest_of(n_bytes: int, chunks: list[tuple[bytes, bytes]]) -> bytes:
    return HEADER.pack(MAGIC, n_bytes, len(chunks)) + b"".join([ENTRY.pack(digest, len(chunk)) for digest, chunk in chunks])


def entries(manifest: bytes) -> list[tuple[bytes, int]]:
    """(digest, size) of each chunk."""
    magic, _, n = HEADER.unpack_from(manifest)
    if magic != MAGIC or len(manifest) != HEADER.size + n * ENTRY.size:
        raise ValueError("no manifest")
    return list(ENTRY.iter_unpack(manifest[HEADER.size :]))


CUT = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("manifest", pa.binary()), ("payload", pa.binary())])
CHUNK = pa.schema([("row_id", pa.int64()), ("seq", pa.int32()), ("digest", pa.binary())])
BODY = pa.schema([("digest", pa.binary()), ("body", pa.binary())])
STORED = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("manifest", pa.binary()), ("whose", pa.binary()), ("n_foreign", pa.int32()), ("n_shared", pa.int32()), ("samples", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for row_id, doc_id, text in zip(*batch.columns, strict=True):
                data = (text.as_py() or "").encode("utf-8", "replace")
                payload = data + bytes(-len(data) % UNIT if data else UNIT)
                yield row_id.as_py(), doc_id.as_py(), manifest_of(len(data), list(chunks_of(payload))), payload

    return _batches(rows(), CUT)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row_id, manifest, whose or null) to a row for each chunk, of foreign ones only if whose is given."""

    def rows():
        for batch in batches:
            for row_id, manifest, whose in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for seq, (digest, _) in enumerate(entries(manifest)):
                    if whose is None or whose[seq] == FOREIGN:
                        yield row_id, seq, digest

    return _batches(rows(), CHUNK)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row_id, doc_id, manifest, payload, marks: list of seq << 2 | whose) to stored rows."""

    def rows():
        for batch in batches:
            for row_id, doc_id, manifest, payload, marks in zip(*batch.columns, strict=True):
                manifest, payload = manifest.as_py(), payload.as_py()
                sizes = [size for _, size in entries(manifest)]
                whose = bytearray(len(sizes))
                for mark in marks.as_py() or ():
                    whose[mark >> 2] = mark & 3
                if FOREIGN in whose:
                    ends = np.cumsum(sizes).tolist()
                    samples = b"".join([payload[end - size : end] for w, size, end in zip(whose, sizes, ends, strict=True) if w != FOREIGN])
                else:
                    samples = payload
                yield row_id.as_py(), doc_id.as_py(), manifest, bytes(whose), whose.count(FOREIGN), whose.count(SHARED), samples

    return _batches(rows(), STORED)


class Store:
    """A written chunk store: a row for each document, and the digests that very many rows name."""

    def __init__(self, rows: DataFrame, heavy: DataFrame):
        self.rows, self.heavy = rows, heavy

    def drop(self) -> None:
        release(self.rows)
        release(self.heavy)


def write_store(docs: DataFrame) -> Store:
    """Cuts all texts and stores each distinct chunk once, with its owner."""
    ship(docs.sparkSession)
    cut = stored(numbered(docs).mapInArrow(tidily(_cut), _ddl(CUT)), "cut")
    chunks = cut.select("row_id", "manifest", F.lit(None).cast("binary").alias("whose")).mapInArrow(tidily(_listed), _ddl(CHUNK))
    found = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "seq")).alias("owner")).where("n > 1")
    shared = stored(found.select("digest", "n", F.col("owner.row_id").alias("owner"), F.col("owner.seq").alias("owner_seq")), "shared")
    total = chunks.agg(F.count("*").alias("total"))
    heavy = stored(shared.join(F.broadcast(total), F.col("n") * HEAVY > F.col("total")).select("digest", "owner", "owner_seq"), "heavy")
    light = shared.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    of = chunks.join(F.broadcast(heavy), "digest").unionByName(chunks.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light, "digest").drop("n"))
    foreign = of.where("row_id <> owner or seq <> owner_seq").select("row_id", (F.col("seq") * 4 + FOREIGN).alias("mark"))
    owned = shared.select(F.col("owner").alias("row_id"), (F.col("owner_seq") * 4 + SHARED).alias("mark"))
    marks = stored(foreign.unionByName(owned), "marks")
    few = marks.limit(MODEST + 1).count() <= MODEST
    by_row = marks.groupBy("row_id").agg(F.collect_list("mark").alias("marks"))
    placed = cut.join(F.broadcast(by_row) if few else by_row, "row_id", "left").select("row_id", "doc_id", "manifest", "payload", "marks")
    rows = stored(placed.mapInArrow(tidily(_place), _ddl(STORED)), "media")
    for done in (cut, shared, marks):
        release(done)
    return Store(rows, heavy.select("digest"))


def feature(payload: bytes) -> str:
    """Distinct samples, their mean and their entropy in bits."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n = counts.sum()
    share = counts[counts > 0] / n
    return f"{len(share)}:{counts @ np.arange(256) / n:.6f}:{-(share * np.log2(share)).sum() + 0.0:.6f}"


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_chunks", pa.int32()), ("feature", pa.string())])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (manifest, whose, samples) to the chunks that other rows name."""

    def rows():
        for batch in batches:
            for manifest, whose, samples in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = 0
                for (digest, size), w in zip(entries(manifest), whose, strict=True):
                    if w == SHARED:
                        yield digest, samples[at : at + size]
                    at += size if w != FOREIGN else 0

    return _batches(rows(), BODY)


def media_row(doc_id: int | None, manifest: bytes, whose: bytes, samples: bytes, given: dict[int, bytes]) -> tuple:
    """The verified payload of a stored row and the chunks given to it, with what is computed of the bytes read."""
    found, at = [], 0
    for seq, ((digest, size), w) in enumerate(zip(entries(manifest), whose, strict=True)):
        chunk = given.get(seq, b"") if w == FOREIGN else samples[at : at + size]
        at += size if w != FOREIGN else 0
        if len(chunk) != size or hashlib.sha256(chunk).digest() != digest:
            raise ValueError(f"document {doc_id} lacks chunk {seq}, or it isn't what the manifest names")
        found.append(chunk)
    payload, (_, n_bytes, n) = b"".join(found), HEADER.unpack_from(manifest)
    if at != len(samples) or len(payload) != max(n_bytes + -n_bytes % UNIT, UNIT):
        raise ValueError(f"document {doc_id} has samples that its manifest doesn't name")
    form = hashlib.sha256(manifest)
    form.update(payload)
    return doc_id, n_bytes, payload, len(manifest) + len(payload), form.hexdigest(), n, feature(payload)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, manifest, whose, samples) that own all their chunks to media."""
    rows = (media_row(*(x.as_py() for x in row), {}) for batch in batches for row in zip(*batch.columns, strict=True))
    return _batches(rows, MEDIA)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (row_id, seq, doc_id, manifest, whose, samples, body) to media: each document's row (seq -1) comes before its foreign chunks."""

    def rows():
        row, of, given = None, None, {}
        for batch in batches:
            for row_id, seq, *stored_row, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seq < 0:
                    if row is not None:
                        yield media_row(*row, given)
                    row, of, given = stored_row, row_id, {}
                elif row_id != of or seq in given:
                    raise ValueError(f"chunk {seq} of row {row_id} has no document or comes twice")
                else:
                    given[seq] = body or b""
        if row is not None:
            yield media_row(*row, given)

    return _batches(rows(), MEDIA)


def read_media(store: Store) -> DataFrame:
    """Every document's payload put together from the store and verified, with its stored form's length and digest and its feature."""
    rows, heavy = store.rows, store.heavy
    ship(rows.sparkSession)
    whole = rows.where("n_foreign = 0").select("doc_id", "manifest", "whose", "samples").mapInArrow(tidily(_whole), _ddl(MEDIA))
    bodies = rows.where("n_shared > 0").select("manifest", "whose", "samples").mapInArrow(tidily(_bodies), _ddl(BODY))
    lacking = rows.where("n_foreign > 0")
    refs = lacking.select("row_id", "manifest", "whose").mapInArrow(tidily(_listed), _ddl(CHUNK))
    # Outer joins: a chunk that is missing must be noticed.
    often = refs.join(F.broadcast(heavy), "digest", "left_semi").join(F.broadcast(bodies.join(F.broadcast(heavy), "digest", "left_semi")), "digest", "left")
    parts = often.unionByName(refs.join(F.broadcast(heavy), "digest", "left_anti").join(bodies, "digest", "left"))
    own = lacking.select("row_id", F.lit(-1).alias("seq"), "doc_id", "manifest", "whose", "samples", F.lit(None).cast("binary").alias("body"))
    every = own.unionByName(parts.select("row_id", "seq", "body"), allowMissingColumns=True)
    mixed = every.repartition("row_id").sortWithinPartitions("row_id", "seq").mapInArrow(tidily(_assembled), _ddl(MEDIA))
    return whole.unionByName(mixed)


def op1_media_chunks(spark, sf_dir: str) -> DataFrame:
    """All texts through the chunk store and back."""
    media = read_media(write_store(table(spark, sf_dir, "documents")))
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        F.col("n_chunks").cast("long").alias("n_chunks"),
    )
