"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint has a bit where more than half of the XXH64 values of a text's
shingles have it. Two fingerprints within RADIUS = 3 bits must be found without
comparing all pairs:

* The 64 bits are three segments of 22, 21 and 21 bits, each padded with zeros to
  the 23 bits of the perfect binary Golay code, in which each word lies within
  3 bits of exactly one codeword. A segment's own index is that codeword's
  number; its nearby indices are those of all words one bit away: one index if
  the segment is within 2 bits of its codeword, six at most otherwise.
* Pigeonhole: 3 errors over three segments leave two segments with one error at
  most. For each pair of segments a fingerprint has keys (own index, nearby
  index) and keys (nearby index, own index). If both segments differ in one bit
  at most, the own index of each is nearby for the other, so some key of the one
  kind equals some key of the other.
* The keys are joined by a sort-merge over hash partitions; candidates are
  verified bit by bit, and only verified links are emitted.

A key with more than HOT fingerprints on one side isn't compared pairwise. All
its fingerprints are linked through points of the 64-bit space instead: two
fingerprints within 3 bits have a point 1 bit from the one and 2 from the other,
so each emits the points of its 1-ball and 2-ball (2,081 rows), and each point
links the least fingerprint that has it in its 1-ball to all that have it. Every
such link is real, and the links connect whatever pairs would connect. The cost
is linear in the fingerprints, so no key is capped and none is quadratic.

Work is on distinct fingerprints: copies are never expanded into pairs. Only
doc_id and text are read. Null and blank texts have fingerprint zero. Repeated
rows each get a row with the same component. Rows with null doc_id are in a
component but never name it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, table, tidily
from .components import connected

SHINGLE = 3
RADIUS = 3
HOT = 4096
SEED = 42
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Shingles that are counted at once, and candidate pairs that are verified at once.
BLOCK, PAIRS = 1 << 15, 1 << 20


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    parts = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), SEED) for i in range(at, min(n, at + BLOCK))], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), words) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidily(run), "doc_id long, fp long")


def _remainders(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words by the generator."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ GENERATOR << bit - 11, left)
    return left


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of low 12 and high 11 bits of a word, and the error pattern of each syndrome."""
    errors = np.zeros(2048, np.int64)
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)])
    errors[_remainders(patterns)] = patterns
    return _remainders(np.arange(4096)), _remainders(np.arange(2048) << 12), errors


_LOW, _HIGH, _ERRORS = _golay()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The number (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ _ERRORS[_LOW[words & 4095] ^ _HIGH[words >> 12]]) >> 11


def nearby(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the distinct codeword numbers of each word and of all words one bit away."""
    around = np.stack([codeword_index(words), *[codeword_index(words ^ (1 << b)) for b in range(width)]], axis=1)
    around.sort(axis=1)
    first = np.ones(around.shape, bool)
    first[:, 1:] = around[:, 1:] != around[:, :-1]
    row, col = np.nonzero(first)
    return row, around[row, col]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, side, fp) rows of these fingerprints."""
    bits = fps.view(np.uint64)
    segments = [(bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    own = [codeword_index(s) for s in segments]
    near = [nearby(s, width) for s, (_, width) in zip(segments, SEGMENTS, strict=True)]
    key, side, fp = [], [], []
    for pair, (i, j) in enumerate(combinations(range(3), 2)):
        row, index = near[j]
        key.append(pair << 24 | own[i][row] << 12 | index)
        side.append(np.zeros(len(row), np.int8))
        fp.append(fps[row])
        row, index = near[i]
        key.append(pair << 24 | index << 12 | own[j][row])
        side.append(np.ones(len(row), np.int8))
        fp.append(fps[row])
    return np.concatenate(key).astype(np.int32), np.concatenate(side), np.concatenate(fp)


def _verified(key: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among whole key groups, sorted by key and side."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    lefts = np.add.reduceat(side == 0, starts)
    rights = sizes - lefts
    group = np.repeat(np.arange(len(starts)), sizes)
    left = np.flatnonzero((side == 0) & (rights[group] > 0))
    each = rights[group[left]]
    ends = np.cumsum(each)
    at = 0
    while at < len(left):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = each[at:upto]
        a = np.repeat(left[at:upto], n)
        g = group[left[at:upto]]
        b = np.repeat(starts[g] + lefts[g] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(a))
        x, y = fp[a], fp[b]
        ok = (x < y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= radius)
        if ok.any():
            yield x[ok], y[ok]
        at = upto


def _joined(hot: int, radius: int):
    """Links of rows (key, side, fp) sorted by key and side; (fp, null) for fingerprints of hot keys."""

    def out(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32), np.empty(0, np.int8), np.empty(0, np.int64)]
        hot_key = None
        for batch in batches:
            rows = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
            if hot_key is not None:
                more = rows[0] == hot_key
                yield out(np.unique(rows[2][more]), None)
                rows = [r[~more] for r in rows]
            yield from groups(rows, final := int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0)
            held = [r[final:] for r in rows]
            if len(held[0]) > 2 * hot:
                hot_key = held[0][0]
                yield out(np.unique(held[2]), None)
                held = [r[:0] for r in held]
        yield from groups(held, len(held[0]))

    def groups(rows: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
        key, side, fp = (r[:n] for r in rows)
        if not n:
            return
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, n])
        large = np.repeat(sizes > 2 * hot, sizes)
        if large.any():
            yield out(np.unique(fp[large]), None)
            key, side, fp = key[~large], side[~large], fp[~large]
        for u, v in _verified(key, side, fp, radius) if len(key) else ():
            yield out(u, v)

    return run


def _ball_links(fps: DataFrame) -> DataFrame:
    """Links of fingerprints of hot keys, through points near them (see the module's text)."""
    bits = [1 << b for b in range(63)] + [-(1 << 63)]
    masks = [0, *bits, *[a ^ b for a, b in combinations(bits, 2)]]
    points = fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select("fp", F.expr("fp ^ mask").alias("point"), (F.bit_count("mask") <= 1).alias("near"))
    centre = points.where("near").groupBy("point").agg(F.min("fp").alias("u"))
    return points.join(centre, "point").where("fp <> u").select(F.least("u", "fp").alias("u"), F.greatest("u", "fp").alias("v"))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v), u < v, of distinct fingerprints (column fp) within RADIUS bits; of those that share a hot key, links that connect them."""
    ship(fps.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in keys(values[at : at + 4096])], ["key", "side", "fp"])

    keyed = fps.select("fp").mapInArrow(tidily(emit), "key int, side byte, fp long").repartition("key").sortWithinPartitions("key", "side")
    found = stored(keyed.mapInArrow(tidily(_joined(hot, RADIUS)), "u long, v long").distinct(), "pairs")
    crowded = found.where("v is null").select(F.col("u").alias("fp"))
    return found.where("v is not null").unionByName(_ball_links(crowded)).distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id reachable over links)."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = connected(links(nodes, hot)).withColumnRenamed("u", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.format_string("%016x", "fp").alias("fingerprint"), "component_id")
