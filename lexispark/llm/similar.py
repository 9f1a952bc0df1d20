"""Documents of similar shingle sets: the wider form of the Golay-code SimHash.

Near copies with some per cent of their words changed differ in more bits of a
64-bit fingerprint than its keys cover. Here a document's signature has TABLES
fingerprints, made from one hash of each shingle by TABLES mixings: 512 bits, cut
into 22 segments of 23 bits, each decoded to its Golay codeword's index. The
decoding makes an index fuzzy by itself: two words a few bits apart often have the
same nearest codeword. Two signatures meet under a key for each pair of segments in
which they decode alike. By the pigeonhole principle signatures that differ in 20 of
the 506 bits at most have two segments without an error and always meet. Beyond
that they meet with a probability: a segment's own index agrees in 12 of 100 cases
at a Jaccard similarity of 0.8, 16 at 0.85 and 22 at 0.9, and two of 22 must. The
nearby indices of one segment (as the 64-bit form uses) agree in 30, 37 and 49 of 100
cases, but cost five keys each: for the same number of keys, pairs of own indices
find about two and a half times as many, so here each segment gives its own
index, and more pairs of segments are used instead.

Under each key, the first 128 bits of the signatures that meet are compared, and
a minimum spanning forest of those within CLOSE bits is emitted, so that the pairs
stay linear in the members. A key with more than CROWD of them is only counted; then
its members are dealt to blocks, each the work of one task. The deal differs from key
to key, so members that one key parts meet under others. Every emitted pair is
verified by the exact Jaccard similarity of the two shingle sets, and verified pairs
are joined to components.

That search is fast, not whole: signatures can fail to meet, a forest can run over
a member that is not similar, and blocks are not compared with each other. So a
second search, exact for every length and similarity, adds what is missing
(prefix filtering). With the hashes of all sets in one order, two sets of
similarity s share one of their first n - ceil(s n) + 1 hashes, with enough hashes
before and behind it in both, and so many of them that the rest can make up the
overlap that s asks for. All pairs that these bounds allow are verified, unless
the first search has already joined their components. Where a hash brings more than
SHARE pairs a row, its rows are named instead of its pairs, so that what is listed grows
with the rows. Those rows meet once more with a sketch of their sets: BUCKETS counts of
hashes, whose differences sum up to no more than the sets differ in. A pair whose
sketches differ by more than similarity s allows is not similar, whatever its texts,
and is not listed. The order puts hashes that many sets have last; any
order gives the same result. A hash of more than CROWD sets is dealt to many
tasks, each of which compares one block with another, so that all blocks meet. Hashes
that are frequent in a part of the corpus are known beforehand; any other whose sets
of several components exceed what a task holds is named by that task instead of
compared, and all rows are joined once more with those hashes dealt to blocks too.

Equal signatures are one node, each of its documents linked with the first and
verified like any pair. Null and blank texts have the empty shingle alone and are
alike. Rows with null doc_id belong to a component but never name it. Only doc_id
and text are read; an input that isn't read from files as it is gets stored first, so
that its rows keep their numbers. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order, modest, numbered, release, ship, stored, tidily
from .components import connected
from .simhash import BLOCK, SEED, codeword_index

WORDS, SIMILARITY = 5, 0.8
TABLES = 8
SEGMENT, SEGMENTS = 23, 22
#: Different bits of 128: pairs of similarity 0.8 differ in 20 on average, unrelated ones in 64.
CLOSE = 40
CROWD = 20_000
#: A task of the second search holds so many times CROWD rows of a hash: two blocks, and room for uneven ones.
ROOM = 4
#: Pairs that a hash lists for each of its rows at most, before its rows are compared by sketches.
SHARE = 2
#: Counts of a sketch, and pairs of sketches that are compared at once.
BUCKETS, SKETCHES = 128, 1 << 14
#: Hashes that are counted at once, and how often one must be among them to count as frequent; the most that are kept.
COUNTED, OFTEN, FREQUENT = 1 << 21, 16, 200_000
#: Members of a key that are set against all others at once.
ROWS = 256
#: Bytes of shingle sets that are compared at once.
SETS = 4 << 20

_PAIRS = list(combinations(range(SEGMENTS), 2))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    n = max(1, len(parts) - words + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), SEED) for i in range(n)], np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """TABLES fingerprints over a set of hashes."""
    out = np.empty(TABLES, np.uint64)
    for t in range(TABLES):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), BLOCK):
            h = hashes[at : at + BLOCK] ^ np.uint64(t * 0x9E3779B97F4A7C15 % (1 << 64))
            for shift in (32, 29):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[t] = np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """How many hashes of a set fall into each bucket, 255 at most: two sets differ in as many hashes as their counts do, or more."""
    return np.minimum(np.bincount(hashes & np.uint64(BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """row_id, doc_id, the fingerprints f0, f1, ..., and the sketch"""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sketches = [], []
            for t in batch.column(2):
                hashes = shingles(t.as_py(), words)
                prints.append(signature(hashes))
                sketches.append(sketch(hashes).tobytes())
            found = np.array(prints, np.uint64).reshape(-1, TABLES).view(np.int64)
            columns = [batch.column(0), batch.column(1), *[pa.array(found[:, t]) for t in range(TABLES)], pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row_id", "doc_id", *[f"f{t}" for t in range(TABLES)], "sketch"])

    return numbered(docs).mapInArrow(tidily(run), "row_id long, doc_id long, " + ", ".join(f"f{t} long" for t in range(TABLES)) + ", sketch binary")


def segment_keys(prints: np.ndarray) -> np.ndarray:
    """A key for each pair of segments of each row of fingerprints: the pair and both indices."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")[:, : SEGMENT * SEGMENTS]
    words = bits.reshape(len(prints), SEGMENTS, SEGMENT).astype(np.int64) @ (1 << np.arange(SEGMENT))
    index = codeword_index(words)
    return np.stack([n << 24 | index[:, i] << 12 | index[:, j] for n, (i, j) in enumerate(_PAIRS)], axis=1).astype(np.int32)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, f0, f1, ...) to rows (key, node, f0, f1)."""
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        for at in range(0, len(columns[0]), 512):
            node, *prints = (c[at : at + 512] for c in columns)
            keys = segment_keys(np.stack(prints, axis=1))
            repeat = lambda c: pa.array(np.repeat(c, len(_PAIRS)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), repeat(node), repeat(prints[0]), repeat(prints[1])], ["key", "node", "a", "b"])


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest over members within CLOSE bits (Prim's way, from the nearest on)."""
    n = len(a)
    near, by = np.full(n, 129), np.zeros(n, np.int64)
    out, edges = np.ones(n, bool), []
    at = 0
    for _ in range(n - 1):
        out[at] = False
        near[at] = 130
        apart = np.bitwise_count(a ^ a[at]).astype(np.int64) + np.bitwise_count(b ^ b[at])
        nearer = out & (apart < near)
        near[nearer], by[nearer] = apart[nearer], at
        at = int(np.where(out, near, 131).argmin())
        if near[at] <= CLOSE:
            edges.append((int(by[at]), at))
        near[at] = 130
    return edges


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of rows sorted by the first `keys` of them: whole groups together, and (True) pieces of a group of more than `most` rows."""
    held: list[np.ndarray] | None = None
    large: list | None = None  # the group whose pieces have gone already
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if large is not None:
            n = int(np.count_nonzero(np.all([r == k for r, k in zip(rows, large, strict=False)], axis=0)))
            if n:
                yield [r[:n] for r in rows], True
            rows = [r[n:] for r in rows]
        if not len(rows[0]):
            continue
        large = None
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        starts = np.flatnonzero(np.r_[True, np.any([r[1:] != r[:-1] for r in rows[:keys]], axis=0)])
        sizes = np.diff(starts)
        for at in np.flatnonzero(sizes > most):
            yield [r[starts[at] : starts[at + 1]] for r in rows], True
        small = np.repeat(sizes <= most, sizes)
        if small.any():
            yield [r[: len(small)][small] for r in rows], False
        held = [r[starts[-1] :] for r in rows]
        if len(held[0]) > most:
            yield held, True
            large, held = [r[0] for r in held[:keys]], None
    if held is not None:
        yield held, False


def _span(most: int):
    """Pairs of nodes from rows sorted by key; of a key with more rows, (key, null, n) for n of them."""

    def groups(key: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]  # most keys that are shared at all
        two = two[np.bitwise_count(a[two] ^ a[two + 1]).astype(np.int64) + np.bitwise_count(b[two] ^ b[two + 1]) <= CLOSE]
        u, v = [node[two]], [node[two + 1]]
        for at, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            edges = spanning(a[at : at + size], b[at : at + size])
            if edges:
                i, j = np.array(edges).T
                u.append(node[at + i])
                v.append(node[at + j])
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.nulls(len(u), pa.int64())], ["u", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, crowded in _grouped(batches, 1, most):
            if crowded:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0][:1].astype(np.int64)), pa.nulls(1, pa.int64()), pa.array([len(rows[0])], pa.int64())], ["u", "v", "n"])
            else:
                yield groups(*rows[:2], *(r.view(np.uint64) for r in rows[2:]))

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, left, right: packed sorted hashes) to (u, v, similarity)."""
    for batch in batches:
        found = []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (left, right))
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["u", "v", "similarity"])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, packed, held = [], [], 0
            for row_id, text in zip(batch.column(0), batch.column(1), strict=True):
                packed.append(shingles(text.as_py(), words).tobytes())
                rows.append(row_id.as_py())
                held += len(packed[-1])
                if held > SETS:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(packed, pa.binary())], ["row_id", "hashes"])
                    rows, packed, held = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(packed, pa.binary())], ["row_id", "hashes"])

    return run


def _frequent(words: int, often: int):
    """(key, n): hashes that at least `often` of COUNTED hashes are."""

    def counts(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key[n >= often].view(np.int64)), pa.array(n[n >= often])], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py(), words))
                many += len(held[-1])
                if many >= COUNTED:
                    yield counts(held)
                    held, many = [], 0
        if held:
            yield counts(held)

    return run


def prefix(hashes: np.ndarray, frequent: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a sorted set, rare ones first: sets of that similarity share one of them."""
    often = np.zeros(len(hashes), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        often = np.where(frequent[at] == hashes, n[at], 0)
    length = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    return hashes[np.lexsort((hashes, often))][:length]


_PREFIX = "key long, part long, block int, node long, root long, size int, at int"


def _prefixes(words: int, similarity: float, frequent: np.ndarray, n: np.ndarray, crowd: int):
    """Rows (row_id, root, text) to a row for each hash of the prefix; those of crowded hashes go to each part their block meets another in."""
    names = [c.split()[0] for c in _PREFIX.split(", ")]
    blocks = dict(zip(frequent[n > crowd].tolist(), (-(-n[n > crowd] // crowd)).tolist(), strict=True))

    def rows(node: int, root: int, hashes: np.ndarray) -> np.ndarray:
        first = prefix(hashes, frequent, n, similarity)
        out = np.zeros((len(first), 7), np.int64)
        out[:, 0], out[:, 3], out[:, 4], out[:, 5], out[:, 6] = first.view(np.int64), node, root, len(hashes), np.arange(len(first))
        crowded = [(i, blocks[h]) for i, h in enumerate(first.tolist()) if h in blocks] if blocks else []
        if not crowded:
            return out
        more = [np.delete(out, [i for i, _ in crowded], axis=0)]
        for i, b in crowded:
            own = xxhash.xxh64_intdigest(node.to_bytes(8, "little"), SEED) % b
            copy = np.repeat(out[i : i + 1], b, axis=0)
            copy[:, 1] = [min(own, other) * b + max(own, other) for other in range(b)]
            copy[:, 2] = own
            more.append(copy)
        return np.concatenate(more)

    def batch_of(held: list[np.ndarray]) -> pa.RecordBatch:
        columns = np.concatenate(held).T
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if k in (0, 1, 3, 4) else np.int32)) for k, c in enumerate(columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, many = [], 0
            for node, root, text in zip(*batch.columns, strict=True):
                held.append(rows(node.as_py(), root.as_py(), shingles(text.as_py(), words)))
                many += len(held[-1])
                if many >= 1 << 15:
                    yield batch_of(held)
                    held, many = [], 0
            if held:
                yield batch_of(held)

    return run


_MET = "u long, v long, need int, part long, block int, root long, size int, at int"


def _across(similarity: float, most: int, share: float = math.inf):
    """Pairs of nodes of different roots that size, place and (if the rows have them) sketches allow, and how many hashes of their prefixes they must share, from rows sorted by key and part.

    Where a part brings more than `share` pairs a row, those of its rows that pair at all
    come instead: (key, node, null) and the rest of the row. A part with more than `most`
    rows isn't compared: (key, null, null) names its key if it has several roots.
    """

    names = [c.split()[0] for c in _MET.split(", ")]
    types = [pa.int32() if c.endswith("int") else pa.int64() for c in _MET.split(", ")]

    def batch_of(*columns: np.ndarray) -> pa.RecordBatch:
        given = [pa.nulls(len(columns[0]), t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=False)]
        return pa.RecordBatch.from_arrays(given + [pa.nulls(len(columns[0]), t) for t in types[len(given) :]], names)

    def overlap(m: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.ceil(similarity / (1 + similarity) * (m.astype(np.int64) + n) - 1e-6).astype(np.int64)

    def fit(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        root, size, at = x[4:7]
        root2, size2, at2 = y[4:7]
        most = np.minimum(at, at2) + np.minimum(size - at, size2 - at2)  # shared hashes before this one, and from it on
        return (root != root2) & (most >= similarity / (1 + similarity) * (size + size2) - 1e-6)

    def near(rows: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs whose sketches differ by no more than their sets may."""
        if len(rows) < 8 or not len(i):
            return i, j
        counts = np.frombuffer(b"".join(rows[7]), np.uint8).reshape(-1, BUCKETS).astype(np.int16)
        kept = np.empty(len(i), bool)
        for at in range(0, len(i), SKETCHES):
            x, y = i[at : at + SKETCHES], j[at : at + SKETCHES]
            m, n = rows[5][x], rows[5][y]
            kept[at : at + SKETCHES] = np.abs(counts[x] - counts[y]).sum(axis=1, dtype=np.int64) <= m.astype(np.int64) + n - 2 * overlap(m, n)
        return i[kept], j[kept]

    def found(rows: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        u, v, m, n = rows[3][i], rows[3][j], rows[5][i], rows[5][j]
        rest = np.ceil(similarity * np.maximum(m, n) - 1e-9).astype(np.int64) - 1  # hashes behind the longer prefix
        return batch_of(np.minimum(u, v), np.maximum(u, v), overlap(m, n) - rest)

    def pairs(some: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size, apart = len(some[0]), some[2].min() != some[2].max()
        for at in range(0, size - 1, ROWS):
            x, y = [r[at : at + ROWS, None] for r in some[:7]], [r[None, at:] for r in some[:7]]
            fits = fit(x, y)
            if apart:
                fits &= x[2] != y[2]
            i, j = near(some, *(at + k for k in np.nonzero(np.triu(fits, 1))))
            if len(i):
                yield i, j

    def listed(some: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The pairs of a group, or its rows if they are fewer by far."""
        held, many, paired = [], 0, None
        for i, j in pairs(some):
            many += len(i)
            if share == math.inf:
                yield found(some, i, j)
                continue
            held.append((i, j))
            if many > share * len(some[0]):
                paired = np.zeros(len(some[0]), bool) if paired is None else paired
                for k in held:
                    paired[k[0]] = paired[k[1]] = True
                held = []
        if paired is not None:
            key, part, block, node, root, size, at = (r[paired] for r in some[:7])
            yield batch_of(key, node, None, part, block, root, size, at)
        elif held:
            yield found(some, *(np.concatenate(k) for k in zip(*held, strict=True)))

    def groups(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, part = rows[:2]
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        sizes = np.diff(np.r_[starts, len(key)])
        mixed = np.minimum.reduceat(rows[4], starts) != np.maximum.reduceat(rows[4], starts)
        two = starts[mixed & (sizes == 2)]
        two = two[fit([r[two] for r in rows], [r[two + 1] for r in rows])]
        yield found(rows, *near(rows, two, two + 1))
        for begin, size in zip(starts[mixed & (sizes > 2)], sizes[mixed & (sizes > 2)], strict=True):
            yield from listed([r[begin : begin + size] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = root = None  # of the last piece; the root is None once the key is named
        for rows, crowded in _grouped(batches, 2, most):
            if not crowded:
                yield from groups(rows)
                continue
            if group != (group := (rows[0][0], rows[1][0])):
                root = rows[4][0]
            if root is not None and (rows[4] != root).any():
                root = None
                yield batch_of(rows[0][:1])

    return run


def _verified(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the stored pairs (u, v) that are similar, with their similarity."""
    ends = stored(pairs.select(F.col("u").alias("row_id")).unionByName(pairs.select(F.col("v").alias("row_id"))).distinct(), "ends")
    texts = numbered(docs).select("row_id", "text").join(modest(ends), "row_id", "left_semi")
    sets = stored(texts.mapInArrow(tidily(_sets(words)), "row_id long, hashes binary"), "sets")
    left, right = (sets.select(F.col("row_id").alias(k), F.col("hashes").alias(f"{k}_hashes")) for k in "uv")
    compared = pairs.join(left, "u").join(right, "v").select("u", "v", "u_hashes", "v_hashes").mapInArrow(tidily(_compare), "u long, v long, similarity double")
    linked = stored(compared.where(F.col("similarity") >= similarity), "linked")
    release(sets)
    return linked


def _met(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Pairs (u, v) of nodes that meet under a key and are close there, stored."""
    keyed = nodes.select("node", *names).mapInArrow(tidily(_emit), "key int, node long, a long, b long")
    spanned = lambda rows, most: rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidily(_span(most)), "u long, v long, n long")
    met = stored(spanned(keyed, CROWD).groupBy("u", "v").agg(F.sum("n").alias("n")), "met")
    pairs = met.where("v is not null").select("u", "v")
    crowded = met.where("v is null").select(F.col("u").cast("int").alias("key"), "n")
    if crowded.isEmpty():
        return pairs
    block = F.pmod(F.xxhash64("key", "node"), F.ceil(2 * F.col("n") / CROWD))
    dealt = keyed.join(modest(crowded), "key").select(F.xxhash64("key", block).alias("key"), "node", "a", "b")
    return stored(pairs.unionByName(spanned(dealt, sys.maxsize).select("u", "v")).distinct(), "met")


def _candidates(keyed: DataFrame, similarity: float, sketches: DataFrame | None = None) -> DataFrame:
    """Pairs (u, v) that share as many prefix hashes as they must and whose sketches (row_id, sketch), if given, allow them, stored; no task holds more than ROOM * CROWD rows of a hash, unless it was dealt to blocks by its count."""

    def across(rows: DataFrame, most: int, share: float = math.inf) -> DataFrame:
        return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(tidily(_across(similarity, most, share)), _MET)

    def met(rows: DataFrame, most: int) -> DataFrame:
        pairs = across(rows, most, math.inf if sketches is None else SHARE)
        if sketches is not None:
            first = stored(pairs, "listed")
            named = first.where("part is not null").select(F.col("u").alias("key"), "part", "block", F.col("v").alias("node"), "root", "size", "at")
            sketched = named.join(sketches.withColumnRenamed("row_id", "node"), "node").select("key", "part", "block", "node", "root", "size", "at", "sketch")
            pairs = first.where("part is null").unionByName(across(sketched, sys.maxsize))
        return stored(pairs.groupBy("u", "v").agg(F.count("*").alias("shared"), F.max("need").alias("need")).where("v is null or shared >= need").select("u", "v"), "across")

    found = met(keyed, ROOM * CROWD)
    crowded = found.where("v is null").select(F.col("u").alias("key"))
    if crowded.isEmpty():
        return found
    rows = stored(keyed.join(modest(crowded), "key").select("key", "node", "root", "size", "at").distinct(), "crowded")
    counts = stored(rows.groupBy("key").agg(F.ceil(F.count("*") / CROWD).alias("blocks")), "blocks")
    own = rows.join(modest(counts), "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.least("block", other) * F.col("blocks") + F.greatest("block", other))
    dealt = own.withColumn("part", F.explode(parts)).select("key", "part", F.col("block").cast("int"), "node", "root", "size", "at")
    return met(keyed.join(modest(crowded), "key", "left_anti").unionByName(dealt), sys.maxsize)


def missed(docs: DataFrame, linked: DataFrame, roots: DataFrame, words: int, similarity: float, sketches: DataFrame | None = None) -> DataFrame:
    """All similar pairs (u, v) that lie in different components, up to copies: of equal sets one stands for all that are linked with it."""
    texts = numbered(docs).select("row_id", "text")
    counts = texts.select("text").mapInArrow(tidily(_frequent(words, OFTEN)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    frequent, n = np.array([r.key for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64)
    order = np.argsort(frequent)
    copies = linked.where("similarity = 1").select(F.col("v").alias("u")).distinct().withColumn("copy", F.lit(True))
    known = stored(roots.join(copies, "u", "left").select(F.col("u").alias("row_id"), "root", "copy"), "known")
    rest = texts.join(modest(known), "row_id", "left").where("copy is null").select("row_id", F.coalesce("root", "row_id").alias("root"), "text")
    keyed = rest.mapInArrow(tidily(_prefixes(words, similarity, frequent[order], n[order], CROWD)), _PREFIX)
    return _verified(docs, _candidates(keyed, similarity, sketches), words, similarity)


def _components(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(row_id, doc_id, root) of every row; rows of one root are connected over verified pairs."""
    prints = stored(signatures(docs, words), "signatures")
    names = [f"f{t}" for t in range(TABLES)]
    nodes = stored(prints.groupBy(*names).agg(F.min("row_id").alias("node")), "nodes")
    twins = prints.join(nodes, names).where("row_id <> node").select(F.col("node").alias("u"), F.col("row_id").alias("v"))
    linked = _verified(docs, stored(_met(nodes, names).unionByName(twins), "pairs"), words, similarity)
    first = connected(linked)
    more = missed(docs, linked, first, words, similarity, prints.select("row_id", "sketch"))
    roots = connected(first.select("u", F.col("root").alias("v")).unionByName(more.select("u", "v"))).withColumnRenamed("u", "row_id")
    return prints.select("row_id", "doc_id").join(roots, "row_id", "left").select("row_id", "doc_id", F.coalesce("root", "row_id").alias("root"))


def similar_documents(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: row_id, doc_id, component_id (the least doc_id reachable over verified pairs)."""
    rooted = _components(in_order(docs), words, similarity)
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(ids, "root").select("row_id", "doc_id", "component_id")


def drop_similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the one with the smallest doc_id (null last; of equal doc_ids the first)."""
    docs = in_order(docs)
    rooted = _components(docs, words, similarity)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    first = rooted.groupBy("root").agg(least.alias("least")).select("root", F.col("least.row_id").alias("stays"))
    gone = stored(rooted.join(first, "root").where("row_id <> stays").select(F.col("row_id").alias("_gone")), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_id"))
    return rows.join(modest(gone), F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
