"""Suffix-array dedup by merging Burrows-Wheeler transforms.

Removes each byte covered by a LENGTH-byte string that also starts in a document
with a smaller doc_id. Texts are UTF-8 bytes; strings never cross documents.

Where strings can repeat at all. Each LENGTH-byte window has one anchor, the
leftmost of its GRAM-byte grams with the least hash; equal windows have equal
anchors at equal places. Consecutive windows with one anchor form a context, some
50 to 76 bytes. Equal windows thus lie in contexts of one anchor, so an anchor of
one document only needs no further look. Records (hashes and places, no text) meet
by anchor to find the others; their contexts go on with their bytes. Up to here
nothing is decided: anchors and hashes choose what meets, not what is removed.

Distinct texts. The contexts that meet are sorted by anchor and class (equal
hashes), compared byte by byte with the first of their class, and each distinct
text is kept once, with the least document that has it. The same is done before
the records are sent: in a piece of the input, and in a task for classes that its
pieces repeat, contexts that equal one of a smaller document byte by byte are
marked and not sent. So a class travels a few times for each task, not for each
document.

The merge. The distinct texts that meet under an anchor are shards by the input
partition they come from; each shard's suffixes are sorted alone and leave its
Burrows-Wheeler transform. The transforms are merged by
interleave refinement: a round takes the merged order by k symbols, reads the two
symbols before each suffix, and moves it stably to the bucket of these, which
gives the order by k+2 symbols. No suffixes of different shards are ever compared or
sorted again. A border between neighbours that first shows then means a common
prefix of k or k+1; a suffix with borders on both sides leaves the merge. After
LENGTH symbols what is left are intervals of suffixes with a common prefix of LENGTH
at least. An interval's least document
is the least of its texts'; of each text, the windows whose interval has a smaller
document than the text's own are marked. A text that meets no other needs no merge:
its windows are its own intervals.

An anchor with more than CROWD classes (a common line in very many different
surroundings) would bring them all to one task. Its contexts are cut into their
single windows when their bytes are read, and these are routed by all their bytes.
The number of classes is counted exactly, so nothing depends on a sample.

Null text counts as empty. A row with null doc_id loses nothing and removes
nothing. Rows with one doc_id don't remove from each other; each row gives a row.
Long texts are read in pieces of BATCH bytes. Other columns are ignored; an empty
table gives an empty result. The input must list its rows in the same order each
time it is read, as a table of files does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_BYTES, in_order, numbered, release, ship, stored, table, tidily

LENGTH = 50
GRAM = 24
#: Bytes that are hashed at once.
BATCH = 1 << 20
#: Texts merged at once (a larger group goes alone), and the shards they are dealt to.
TOGETHER, SHARDS = 1024, 4
#: An anchor with more classes is split. A text has at most WIDEST bytes.
CROWD, WIDEST = 4096, 2 * LENGTH - GRAM
#: Classes that a task remembers, contexts whose bytes are read at once, and rows that are settled at once.
KNOWN, READ, ROWS = 20_000, 20_000, 20_000
#: Rows that a task gathers before it sends them, so that a cell holds many.
GATHERED = 400_000

_WORDS = np.array([int.from_bytes(hashlib.sha256(b"repeats %d" % b).digest()[:8], "little") | 1 for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: int) -> np.ndarray:
    out = np.full(BATCH + LENGTH + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of h into every bit of the result."""
    for shift in (32, 29):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Contexts:
    """The contexts of one piece of concatenated texts: first window, windows, anchor's hash and context's hash."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        if not _tables:
            _tables.extend((_powers(_BASE), _powers(_INVERSE)))
        self.power, self.inverse = _tables
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_WORDS[data] * self.power[:n], out=self.sums[1:])
        grams = self.hashes(np.arange(n - GRAM + 1), GRAM)
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width, have = LENGTH - GRAM + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if width > have:
            least = np.minimum(least[: have - width], least[width - have :])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        room = np.maximum(sizes - LENGTH + 1, 0)
        self.window = np.repeat(starts - (np.cumsum(room) - room), room) + np.arange(room.sum())  # windows inside one text
        at = (least[self.window] & _PLACE).astype(np.int64)
        text = np.repeat(np.arange(len(sizes)), room)
        new = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])] if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.begin = self.window[first]
        self.n = np.diff(np.r_[first, len(at)])
        self.text = text[first]
        self.start = starts[self.text]
        place = at[first]
        self.anchor = grams[place]
        shape = (self.n << 8 | (place - self.begin)).astype(np.uint64)
        self.hash = _mixed((self.sums[self.begin + self.n + LENGTH - 1] - self.sums[self.begin]) * self.inverse[self.begin] + shape * np.uint64(_BASE))

    def hashes(self, begin: np.ndarray, size: int) -> np.ndarray:
        return _mixed((self.sums[begin + size] - self.sums[begin]) * self.inverse[begin])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple]]]:
    """(bytes, sizes, (row_id, doc_id, offset) of each part) of about BATCH bytes; rows (row_id, doc_id, text)."""
    parts, of, size = [], [], 0
    for batch in batches:
        for row_id, doc_id, text in zip(*batch.columns, strict=True):
            data, key = (text.as_py() or "").encode("utf-8", "replace"), (row_id.as_py(), doc_id.as_py())
            if len(data) < LENGTH or key[1] is None:
                continue
            for at in range(0, len(data) - LENGTH + 1, BATCH - LENGTH):
                part = data[at : at + BATCH - 1]
                if size + len(part) > BATCH:
                    yield np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), of
                    parts, of, size = [], [], 0
                parts.append(part)
                of.append((*key, at))
                size += len(part)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), of


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def same_bytes(data: np.ndarray, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from first on equal those from second on, for as many as size says (WIDEST at most)."""
    out = np.ones(len(first), bool)
    for at in range(0, len(first), READ):
        x, y, n = (v[at : at + READ, None] for v in (first, second, size))
        step = np.minimum(np.arange(WIDEST)[None], n - 1)
        out[at : at + READ] = (data[x + step] == data[y + step]).all(axis=1)
    return out


def padded(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes from begin on, WIDEST a row, zero from size on."""
    step = np.arange(WIDEST)[None]
    return np.where(step < size[:, None], data[np.minimum(begin[:, None] + step, len(data) - 1)], np.uint8(0))


class _Known:
    """Classes that a task has met in several documents of a piece: the least document sent so far and the bytes of each, sorted by key."""

    def __init__(self):
        self.keys, self.docs, self.texts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, WIDEST), np.uint8)

    def least(self, key: np.ndarray, text: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The least document sent of each class, or the largest number where none is known to have these bytes."""
        out = np.full(len(key), np.iinfo(np.int64).max)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == key)
            hit = hit[(self.texts[at[hit]] == text(hit)).all(axis=1)]
            out[hit] = self.docs[at[hit]]
        return out

    def learn(self, key: np.ndarray, doc: np.ndarray, text: np.ndarray) -> None:
        """Takes in classes sent now; of a class known already the smaller document counts."""
        keys, docs, texts = np.r_[key, self.keys], np.r_[doc, self.docs], np.concatenate((text, self.texts))
        order = np.lexsort((docs, keys))
        order = order[np.r_[True, keys[order][1:] != keys[order][:-1]]] if len(order) else order
        self.keys, self.docs, self.texts = keys[order][:KNOWN], docs[order][:KNOWN], texts[order][:KNOWN]


def _planes(numbers: np.ndarray) -> bytes:
    """First all first bytes, then all second ones: equal high bytes stand together, which compression needs."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _blocks(row_id: np.ndarray, blocks: int) -> np.ndarray:
    """The block that a row belongs to, in which its text and what concerns it meet: 64 rows on end have one."""
    return ((row_id >> 6) + (row_id >> 33) * 31) % blocks


def _cells(block: np.ndarray, columns: list[np.ndarray | None]) -> list[tuple]:
    """(block, packed columns) for each block that has rows."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist() if len(block) else []
    return [(int(block[lo]), *[None if c is None else _planes(c[order[lo:hi]]) for c in columns]) for lo, hi in zip(edges, [*edges, len(block)][1:], strict=True)]


def _cell_batch(cells: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*cells, strict=True) if cells else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(columns)], names)


class _Packer:
    """Gathers rows of a task and sends GATHERED of them at a time as cells."""

    def __init__(self, schema: str, kinds: tuple):
        self.names, self.kinds = _names(schema), kinds
        self.held: list[tuple] = []
        self.n = 0

    def add(self, block: np.ndarray, *columns: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if len(block):
            self.held.append((block, *[None if c is None else c.astype(k) for c, k in zip(columns, self.kinds, strict=True)]))
            self.n += len(block)
        if self.n >= GATHERED:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            block, *columns = zip(*self.held, strict=True)
            cells = _cells(np.concatenate(block), [None if c[0] is None else np.concatenate(c) for c in columns])
            self.held, self.n = [], 0
            yield _cell_batch(cells, self.names)


def _classes(buckets: int, blocks: int):
    """Records by bucket of the anchor, in cells; marks that a task settles alone have no anchor, and the block of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        records, alone = _Packer(_RECORDS, _RECORD), _Packer(_RECORDS, _RECORD)
        for data, sizes, of in _pieces(batches):
            found = Contexts(data, sizes)
            row_ids, doc_ids, offsets = (np.array(x, np.int64) for x in zip(*of, strict=True))
            key, context, n, begin = found.anchor, found.hash, found.n, found.begin
            doc, row = doc_ids[found.text], row_ids[found.text]
            place = begin - found.start + offsets[found.text]
            order = np.lexsort((doc, context, key))
            new = np.r_[True, (key[order][1:] != key[order][:-1]) | (context[order][1:] != context[order][:-1])] if len(order) else np.zeros(0, bool)
            first = order[np.flatnonzero(new)]
            cls = np.cumsum(new) - 1
            head = first[cls]  # of each context in this order: the first of its class, which has the least document
            equal = new.copy()
            rest = np.flatnonzero(~new)
            rest = rest[n[order[rest]] == n[head[rest]]]
            equal[rest] = same_bytes(data, begin[order[rest]], begin[head[rest]], n[order[rest]] + LENGTH - 1)
            name = key[first] ^ context[first]
            text = lambda which: padded(data, begin[first[which]], n[first[which]] + LENGTH - 1)  # noqa: B023, E731
            before = known.least(name, text)
            settled = equal & (doc[order] > np.minimum(doc[head], before[cls]))
            repeated = np.flatnonzero((np.bincount(cls[settled], minlength=len(first)) > 0) & (doc[first] < before))
            known.learn(name[repeated], doc[first[repeated]], text(repeated))
            marked, sent = order[settled], order[~settled]
            yield from records.add((key[sent] >> np.uint64(40)).astype(np.int64) % buckets, key[sent], context[sent], row[sent], doc[sent], place[sent], n[sent])
            yield from alone.add(_blocks(row[marked], blocks), None, None, row[marked], doc[marked], place[marked], n[marked])
        yield from records.rest()
        yield from alone.rest()

    return run


_RECORDS = "bucket int, anchor binary, context binary, row_id binary, doc_id binary, place binary, n binary"
_RECORD = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.uint8)
#: Cells of contexts that are asked for, or (without grp and cls) of marks.
_SIFTED = "block int, rows binary, place binary, n binary, grp binary, cls binary"
_ASKED = (np.int64, np.int32, np.uint8, np.int64, np.int16)
_MARKS = "block int, rows binary, place binary, n binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _sift(blocks: int):
    """From records, sorted by bucket: marks, and the contexts of anchors of two documents or more.

    grp numbers the anchors, cls the classes of each, or is -1 if there are more than CROWD.
    """

    def settled(bucket: int, held: list[list[bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        if not held:
            return
        key, context, row, doc, place, n = (np.concatenate([_numbers(b, k) for b in x]) for x, k in zip(zip(*held, strict=True), _RECORD, strict=True))
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        at = np.flatnonzero(new)
        docs = doc[order]
        shared = np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at)  # only one document has the other anchors
        order = order[shared[np.cumsum(new) - 1]]
        if not len(order):
            return
        order = order[np.lexsort((context[order], key[order]))]
        key, context = key[order], context[order]
        new_key = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new_key) - 1
        cls = np.cumsum(new_key | np.r_[True, context[1:] != context[:-1]]) - 1
        cls -= cls[np.flatnonzero(new_key)][group]
        crowded = np.maximum.reduceat(cls, np.flatnonzero(new_key)) >= CROWD
        cls[crowded[group]] = -1
        yield row[order], place[order], n[order], bucket << 32 | group, cls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Packer(_SIFTED, _ASKED)
        bucket, held = 0, []

        def close() -> Iterator[pa.RecordBatch]:
            for columns in settled(bucket, held):
                yield from asked.add(_blocks(columns[0], blocks), *columns)

        for batch in batches:
            marks = []
            for b, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if columns[0] is None:
                    _, _, row, _, place, n = columns
                    marks.append((b, row, place, n, None, None))
                    continue
                if b != bucket:
                    yield from close()
                    bucket, held = b, []
                held.append(columns)
            if marks:
                yield _cell_batch(marks, _names(_SIFTED))
        yield from close()
        yield from asked.rest()

    return run


def _met(cells: DataFrame, rows: DataFrame, blocks: int) -> DataFrame:
    """The texts of each block after the cells of that block."""
    at = F.pmod(F.shiftright("row_id", 6) + F.shiftright("row_id", 33) * 31, F.lit(blocks)).cast("int")
    texts = rows.select(at.alias("block"), F.lit(1).alias("kind"), "row_id", "doc_id", "text")
    packed = [c for c in cells.columns if c != "block"]
    both = texts.unionByName(cells.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.select("block", "kind", "row_id", "doc_id", "text", *packed).repartitionById(blocks, "block").sortWithinPartitions("block", "kind")


def _joined(batches: Iterator[pa.RecordBatch], kinds: tuple) -> Iterator[tuple]:
    """(row_id, doc_id, text, columns of its cells) of each text; the first packed column holds row ids."""
    block, cells, held = None, [], None
    for batch in batches:
        for b, kind, row_id, doc_id, text, *packed in zip(*batch.columns, strict=True):
            if b.as_py() != block:
                block, cells, held = b.as_py(), [], None
            if not kind.as_py():
                cells.append([p.as_py() for p in packed])
                continue
            if held is None:
                columns = [np.concatenate([np.zeros(0, k), *[_numbers(c[i], k) for c in cells]]) for i, k in enumerate(kinds)]
                order = np.argsort(columns[0], kind="stable")
                cells, held = [], [c[order] for c in columns]
            row = row_id.as_py()
            lo, hi = np.searchsorted(held[0], (row, row + 1))
            yield row, doc_id.as_py(), text.as_py(), [c[lo:hi] for c in held[1:]]


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """The sorted suffixes of one shard, read on cyclically."""
    rank = codes.astype(np.int64)
    width, n = 1, len(codes)
    while True:
        key = rank << 32 | np.roll(rank, -width)
        order = np.argsort(key)
        ordered = key[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        width *= 2
        if new.all() or width >= min(n, LENGTH):
            return order


def merged_intervals(shards: list[np.ndarray], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges shards of codes: the suffixes that share a prefix of `depth` symbols with another, in order, with their interval's number; and
    for each suffix the longest even prefix, up to `depth`, that another one shares.

    Suffixes are numbered through the shards and read on cyclically. A round reads two
    symbols. What differs from all others leaves: so does whatever precedes it, a round
    later, and the rounds become shorter.
    """
    symbols, back, suffix = [], [], []
    at = 0
    for codes in shards:
        order = suffix_order(codes)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        symbols.append(codes[order - 2].astype(np.uint16) << 8 | codes[order - 1])  # the shard's transform, by two
        back.append(place[order - 2] + np.int32(at))
        suffix.append(order + at)
        at += len(codes)
    pair, step, suffix = np.concatenate(symbols), np.concatenate(back), np.concatenate(suffix)
    common = np.zeros(at, np.int32)
    interleave = np.arange(at, dtype=np.int32)  # which shard's next suffix stands at each place: here as its number
    block = np.zeros(at, np.int32)
    for k in range(2, depth + 1, 2):
        read = pair[interleave]
        moved = np.argsort(read, kind="stable")
        read, block = read[moved], block[moved]
        border = np.ones(len(moved) + 1, bool)
        border[1:-1] = (read[1:] != read[:-1]) | (block[1:] != block[:-1])
        stays = ~(border[1:] & border[:-1])
        interleave = step[interleave[moved[stays]]]
        block = np.cumsum(border[:-1], dtype=np.int32)[stays]
        if not len(interleave):
            break
        common[suffix[interleave]] = k
    return suffix[interleave], block, common


def least_documents(texts: list[bytes], docs: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
    """For each window of each text, the least document of its interval; docs: the least document that has each text."""
    parts = [np.flatnonzero(shard == k) for k in np.unique(shard)]
    # 255 is no byte of UTF-8. No window reaches over it, so no suffix that does is like one that begins a window.
    found, interval, _ = merged_intervals([np.frombuffer(b"\xff".join([texts[i] for i in part]) + b"\xff", np.uint8) for part in parts])
    text = np.concatenate(parts)
    size = np.array([len(texts[i]) for i in text.tolist()]) + 1
    start = np.cumsum(size) - size
    least = np.repeat(docs[text], size)
    if len(found):
        new = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
        least[found] = np.repeat(np.minimum.reduceat(least[found], new), np.diff(np.r_[new, len(found)]))
    out: list[np.ndarray] = [least[:0]] * len(texts)
    for i, begin, n in zip(text.tolist(), start.tolist(), size.tolist(), strict=True):
        out[i] = least[begin : begin + n - LENGTH]
    return out


_WEIGHTS = np.array([int.from_bytes(hashlib.sha256(b"window %d" % i).digest()[:8], "little") | 1 for i in range(LENGTH)], np.uint64)
#: Cells of contexts: a compressed run of all their bytes, and packed numbers.
_CONTEXTS = "bucket int, grp binary, cls binary, rows binary, docs binary, place binary, size binary, bytes binary"
_HELD = (np.int64, np.int16, np.int64, np.int64, np.int32, np.uint8)


def _fetch(buckets: int):
    """Texts with what is asked of them (places, counts, groups and classes) to contexts with their bytes; those of split anchors window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        packer = zstandard.ZstdCompressor(level=1)
        size = 0

        def cells() -> pa.RecordBatch:
            columns = [np.concatenate([h[i] for h in held]) for i in range(6)]
            data = np.concatenate([h[6] for h in held])
            begin = np.cumsum(columns[5]) - columns[5]
            bucket = np.concatenate([h[7] for h in held]) % buckets
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
            out = []
            for lo, hi in zip(edges, [*edges, len(order)][1:], strict=True):
                some = order[lo:hi]
                found = data[np.repeat(begin[some], columns[5][some]) + _steps(columns[5][some])]
                out.append((int(bucket[lo]), *[_planes(c[some].astype(k)) for c, k in zip(columns, _HELD, strict=True)], packer.compress(found.tobytes())))
            return _cell_batch(out, _names(_CONTEXTS))

        def add(row: int, doc: int, data: np.ndarray, place: np.ndarray, n: np.ndarray, grp: np.ndarray, cls: np.ndarray, route: np.ndarray) -> int:
            sizes = n + LENGTH - 1
            found = data[np.repeat(place, sizes) + _steps(sizes)]
            held.append((grp, cls, np.full(len(place), row), np.full(len(place), doc), place, sizes, found, route))
            return len(found)

        for row, doc, text, (place, n, grp, cls) in _joined(batches, _ASKED):
            if not len(place):
                continue
            data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            for at in range(0, len(place), READ):
                p, c, g, k = (x[at : at + READ].astype(np.int64) for x in (place, n, grp, cls))
                split = k < 0
                if not split.all():
                    size += add(row, doc, data, p[~split], c[~split], g[~split], k[~split], g[~split] >> 32)
                if split.any():
                    windows = np.repeat(p[split], c[split]) + _steps(c[split])
                    for lo in range(0, len(windows), READ):
                        w = windows[lo : lo + READ]
                        route = _mixed((data[w[:, None] + np.arange(LENGTH)].astype(np.uint64) * _WEIGHTS).sum(axis=1, dtype=np.uint64)).view(np.int64)
                        size += add(row, doc, data, w, np.ones(len(w), np.int64), route, np.zeros(len(w), np.int64), route)
                if size > 4 * ARROW_BYTES:
                    yield cells()
                    held.clear()
                    size = 0
        if held:
            yield cells()

    return run


def settle(grp: np.ndarray, cls: np.ndarray, row: np.ndarray, doc: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Marks (row, place, windows) from the contexts of whole groups, sorted by group and class."""
    n = len(grp)
    new_group = np.r_[True, grp[1:] != grp[:-1]]
    new = new_group | np.r_[True, cls[1:] != cls[:-1]]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = size == size[head]
    same[same] = same_bytes(data, start[same], start[head[same]], size[same])
    group = np.cumsum(new_group) - 1
    if same.all():
        text = np.cumsum(new) - 1
    else:  # hashes that meet by chance: the bytes of every context of these groups tell the texts apart
        number: dict[tuple, int] = {}
        text = np.array([number.setdefault((g, bytes(data[s : s + z])), len(number)) for g, s, z in zip(group.tolist(), start.tolist(), size.tolist(), strict=True)])
    head = np.full(text[-1] + 1 if same.all() else text.max() + 1, -1, np.int64)
    head[text[::-1]] = np.arange(n)[::-1]  # the first context of each text
    least = np.full(len(head), np.iinfo(np.int64).max)
    np.minimum.at(least, text, doc)
    alone = np.bincount(group[head], minlength=group[-1] + 1) == 1
    whole = alone[group] & (doc > least[text])
    yield row[whole], place[whole], size[whole] - LENGTH + 1

    met = np.flatnonzero(~alone[group[head]])  # texts to be merged, by group
    met = met[np.argsort(group[head[met]], kind="stable")]
    if not len(met):
        return
    spans: list[np.ndarray] = []  # text, first window, windows, least document
    at = 0
    of = group[head[met]]
    while at < len(met):
        upto = int(np.searchsorted(of, of[min(at + TOGETHER, len(met)) - 1], "right"))
        some = met[at:upto]
        texts = [bytes(data[start[h] : start[h] + size[h]]) for h in head[some].tolist()]
        found = least_documents(texts, least[some], (row[head[some]] >> 33) % SHARDS)
        flat = np.concatenate(found)
        counts = np.array([len(f) for f in found])
        begins = np.cumsum(counts) - counts
        border = np.r_[True, flat[1:] != flat[:-1]]
        border[begins] = True
        first = np.flatnonzero(border)
        owner = np.searchsorted(begins, first, "right") - 1
        spans.append(np.stack((some[owner], first - begins[owner], np.diff(np.r_[first, len(flat)]), flat[first]), axis=1))
        at = upto
    span = np.concatenate(spans)
    span = span[np.argsort(span[:, 0], kind="stable")]
    member = np.flatnonzero(~alone[group])
    lo, hi = np.searchsorted(span[:, 0], text[member], "left"), np.searchsorted(span[:, 0], text[member], "right")
    which = np.repeat(lo, hi - lo) + _steps(hi - lo)
    who = np.repeat(member, hi - lo)
    hit = doc[who] > span[which, 3]
    yield row[who[hit]], place[who[hit]] + span[which[hit], 1], span[which[hit], 2]


def _merge(blocks: int):
    """Marks from cells of contexts, sorted by bucket."""

    def settled(held: list[list[bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        if not held:
            return
        unpacker = zstandard.ZstdDecompressor()
        grp, cls, row, doc, place, size = (np.concatenate([_numbers(h[i], k) for h in held]) for i, k in enumerate(_HELD))
        data = np.frombuffer(b"".join([unpacker.decompress(h[6]) for h in held]), np.uint8)
        held.clear()
        size = size.astype(np.int64)
        start = np.cumsum(size) - size
        order = np.lexsort((cls, grp))
        edges = np.flatnonzero(np.r_[True, grp[order][1:] != grp[order][:-1], True])
        at = 0
        while at < len(order):
            upto = int(edges[min(np.searchsorted(edges, at + ROWS), len(edges) - 1)])  # whole groups
            some = order[at:upto]
            yield from settle(grp[some], cls[some], row[some], doc[some], place[some].astype(np.int64), start[some], size[some], data)
            at = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _Packer(_MARKS, _ASKED[:3])
        bucket, held = 0, []

        def close() -> Iterator[pa.RecordBatch]:
            for columns in settled(held):
                yield from marks.add(_blocks(columns[0], blocks), *columns)

        for batch in batches:
            for b, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    yield from close()
                    bucket, held = b, []
                held.append(columns)
        yield from close()
        yield from marks.rest()

    return run


CUT = "row_id long, doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their marks to what is left of them, in batches of some MB."""
    out: list[tuple] = []
    held = 0
    for row_id, doc_id, text, (place, n) in _joined(batches, _ASKED[:3]):
        data = (text or "").encode("utf-8", "replace")
        order = np.argsort(place, kind="stable")
        begin = place[order].astype(np.int64)
        end = np.maximum.accumulate(begin + n[order] + LENGTH - 1) if len(begin) else begin
        new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]]) if len(begin) else begin
        spans = list(zip(begin[new].tolist(), end[np.r_[new[1:] - 1, len(end) - 1]].tolist() if len(new) else [], strict=True))
        kept, at = [], 0
        for first, last in spans:
            kept.append(data[at:first])
            at = last
        kept.append(data[at:])
        left = b"".join(kept)
        out.append((row_id, doc_id, len(data), len(data) - len(left), len(spans), [{"start": x, "end": y} for x, y in spans], left))
        held += 64 + len(left)
        if held > ARROW_BYTES:
            yield _cut_batch(out)
            out, held = [], 0
    if out:
        yield _cut_batch(out)


def _cut_batch(out: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = (*[pa.int64()] * 5, span, pa.binary())
    names = ["row_id", "doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Cells of marks: block, and packed rows, places and counts: so many windows from byte `place` on repeat an earlier document."""
    spark = docs.sparkSession
    ship(spark)
    rows = numbered(docs)
    blocks = _blocks_of(spark)
    records = rows.mapInArrow(tidily(_classes(4 * blocks, blocks)), _RECORDS)
    records = records.repartitionById(blocks, F.expr(f"bucket % {blocks}")).sortWithinPartitions("bucket")
    sifted = stored(records.mapInArrow(tidily(_sift(blocks)), _SIFTED), "sifted")
    contexts = _met(sifted.where("grp is not null"), rows, blocks).mapInArrow(tidily(_fetch(blocks)), _CONTEXTS)
    merged = stored(contexts.repartitionById(blocks, "bucket").sortWithinPartitions("bucket").mapInArrow(tidily(_merge(blocks)), _MARKS), "merged")
    alone = stored(sifted.where("grp is null").select(_names(_MARKS)), "alone")
    release(sifted)
    return alone.unionByName(merged)


def _blocks_of(spark) -> int:
    """Blocks of rows, and buckets of contexts: a task holds the numbers of one at a time, so they are as many as the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: row_id, doc_id, n_bytes, n_removed, n_spans, spans (removed bytes, end exclusive) and kept (the remaining bytes)."""
    docs = in_order(docs)
    return _met(repeated_passages(docs), numbered(docs), _blocks_of(docs.sparkSession)).mapInArrow(tidily(_cut), CUT)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
