"""Vector code compression: codebooks by Lloyd's rounds over heaps of slack.

Components become integers floor(256 x), so all distances are exact. A vector is
cut into PARTS equal consecutive parts, each part position has a codebook of
integer entries, and a vector's code is the list of its parts' nearest entries.

* Kept vectors are packed into blocks of BLOCK components, one row of a stored table
  each, which a task reads and writes by itself.
* The first assignment compares every part with every entry. Each part then goes
  into the heap of its entry, in its block, keyed by its slack: the distance to the
  next best entry less that to its own. Drifts of entries are summed up, so a key
  never needs an update: the slack is used up when what its entry and the farthest
  moving other entry have drifted since exceeds it.
* In a later assignment a heap gives up only parts whose keys its cumulative drift
  has reached. They are found from the root down: a part's children can only be
  violated if it is itself. These parts are compared with all entries exactly and
  put into their heaps with new keys; all other parts are neither read nor moved.
  Keys are kept a little too small, by more than the rounding of a square root, so
  ties and rounding lead to a comparison, never to a wrong entry.
* A block sends the sums that its moved parts leave and join, entry by entry. They
  are added up in Spark; what reaches the driver is PARTS * entries rows a round,
  whatever the input. New entries are floor(sum / count) of exact integers.

Vectors that are null or hold a null or non-finite component are dropped, and so
are those whose length isn't that of the first: the first is the kept vector with
the smallest vec_id (null last; then by components), of a length that PARTS
divides. Integer components are limited to +-LARGEST, within which sums of
squares fit a long. With fewer vectors than entries there are as many entries as
vectors. Repeated rows each get their result; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest, release, ship, stored, table, tidily

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Components in a block: 4,096 vectors of 64, fewer of longer ones.
BLOCK = 1 << 18
LARGEST = 1 << 27
#: Keys are smaller than the slack by this share of the distances that they were made from.
MARGIN = 1e-12

STATE = "n int, ids array<long>, labels array<string>, vectors binary, members binary, offsets binary, keys binary, delta binary"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of vectors whose components are all finite numbers, of a length that PARTS divides."""
    odd = lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))
    whole = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), whole.alias("embedding"))
    return rows.where((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & ~F.exists("embedding", odd))


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64)


def first_entries(rows: DataFrame, entries: int) -> np.ndarray:
    """(parts, entries, width): the codebooks that the rounds start from."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(1).collect()
    if not first:
        return np.zeros((PARTS, 0, 1), np.int64)
    dim = len(first[0].embedding)
    chosen = rows.where(F.size("embedding") == dim).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    values = integers(np.array([r.embedding for r in chosen], float))
    return values.reshape(len(chosen), PARTS, dim // PARTS).transpose(1, 0, 2).copy()


class Block:
    """The vectors of a block (n, parts, width), and a heap of slack for each part position and entry.

    A heap is an array in which no key is smaller than its parent's: members of
    position p whose entry is e lie at offsets[p, e] to offsets[p, e + 1].
    """

    def __init__(self, vectors: np.ndarray, entries: int):
        n = len(vectors)
        self.vectors, self.entries = vectors, entries
        self.members = np.zeros((PARTS, n), np.int32)
        self.keys = np.zeros((PARTS, n))
        self.offsets = np.zeros((PARTS, entries + 1), np.int32)
        self.delta = np.zeros((PARTS, entries, vectors.shape[2] + 1), np.int64)
        self.rescanned = 0

    def violated(self, part: int, reach: np.ndarray) -> np.ndarray:
        """Places in the heaps of a position whose keys are at most what their entry's cumulative drift reaches, from the roots down."""
        keys, offsets = self.keys[part], self.offsets[part]
        found = []
        entry = np.flatnonzero(offsets[1:] > offsets[:-1])
        at = np.zeros(len(entry), np.int64)
        while len(entry):
            place = offsets[entry] + at
            hit = keys[place] <= reach[entry]
            entry, at, place = entry[hit], at[hit], place[hit]
            found.append(place)
            entry, at = np.concatenate([entry, entry]), np.concatenate([2 * at + 1, 2 * at + 2])
            inside = offsets[entry] + at < offsets[entry + 1]
            entry, at = entry[inside], at[inside]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _nearest(self, part: int, rows: np.ndarray, codebook: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row (lower index in ties), and its key."""
        points = self.vectors[rows, part].astype(np.int64)
        apart = np.zeros((len(rows), self.entries), np.int64)
        for i in range(points.shape[1]):
            apart += (points[:, i : i + 1] - codebook[None, :, i]) ** 2
        best = apart.argmin(axis=1)
        line = np.arange(len(rows))
        own = np.sqrt(apart[line, best].astype(float))
        apart[line, best] = np.iinfo(np.int64).max
        next_ = np.sqrt(apart.min(axis=1).astype(float)) if self.entries > 1 else np.full(len(rows), np.inf)
        return best, next_ - own - MARGIN * (np.where(np.isinf(next_), 0, next_) + drift[best] + 1) + drift[best]

    def _place(self, part: int, members: np.ndarray, entry: np.ndarray, keys: np.ndarray) -> None:
        """Sorted by key, the members of each entry are a heap."""
        order = np.lexsort((keys, entry))
        self.members[part], self.keys[part] = members[order], keys[order]
        self.offsets[part, 1:] = np.cumsum(np.bincount(entry, minlength=self.entries))

    def assign(self, codebooks: np.ndarray, drift: np.ndarray, first: bool) -> None:
        """Moves what has to move; delta is what the sums and counts of the entries gain."""
        self.delta[:] = 0
        n = len(self.vectors)
        for part in range(PARTS):
            members, keys = self.members[part].copy(), self.keys[part].copy()
            entry = np.repeat(np.arange(self.entries), np.diff(self.offsets[part]))
            if first:
                members, entry = np.arange(n, dtype=np.int32), np.zeros(n, np.int64)
                places = np.arange(n)
            else:
                places = self.violated(part, drift[part])
                if not len(places):
                    continue
            rows = members[places]
            best, found = self._nearest(part, rows, codebooks[part], drift[part])
            self.rescanned += len(rows)
            moved = np.ones(len(rows), bool) if first else best != entry[places]
            gain = np.concatenate([self.vectors[rows[moved], part].astype(np.int64), np.ones((moved.sum(), 1), np.int64)], axis=1)
            np.add.at(self.delta[part], best[moved], gain)
            if not first:
                np.subtract.at(self.delta[part], entry[places][moved], gain)
            entry[places], keys[places] = best, found
            self._place(part, members, entry, keys)

    def codes(self) -> np.ndarray:
        """(n, parts): the entries that the heaps hold."""
        out = np.zeros((len(self.vectors), PARTS), np.int64)
        for part in range(PARTS):
            out[self.members[part], part] = np.repeat(np.arange(self.entries), np.diff(self.offsets[part]))
        return out

    def pack(self, ids: pa.Array, labels: pa.Array) -> pa.RecordBatch:
        one = lambda values: pa.array([values.tobytes()], pa.binary())
        line = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
        columns = [pa.array([len(self.vectors)], pa.int32()), line(ids, pa.int64()), line(labels, pa.string())]
        columns += map(one, (self.vectors, self.members, self.offsets, self.keys, self.delta))
        return pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in STATE.split(", ")])

    @classmethod
    def unpack(cls, row: dict, entries: int, width: int) -> Block:
        n = row["n"]
        out = cls(np.frombuffer(row["vectors"], np.int32).reshape(n, PARTS, width), entries)
        out.members = np.frombuffer(row["members"], np.int32).reshape(PARTS, n).copy()
        out.offsets = np.frombuffer(row["offsets"], np.int32).reshape(PARTS, entries + 1).copy()
        out.keys = np.frombuffer(row["keys"], float).reshape(PARTS, n).copy()
        return out


def _begin(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Blocks with every part assigned for the first time."""
    entries, width = codebooks.shape[1:]
    most = max(1, BLOCK // (PARTS * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block(batch: pa.Table) -> pa.RecordBatch:
            values = batch.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            out = Block(integers(values).astype(np.int32).reshape(-1, PARTS, width), entries)
            out.assign(codebooks, np.zeros((PARTS, entries)), first=True)
            return out.pack(batch.column("vec_id").combine_chunks(), batch.column("label").combine_chunks())

        for batch in batches:
            while len(batch):
                held.append(batch.slice(0, most - size))
                size += len(held[-1])
                batch = batch.slice(len(held[-1]))
                if size == most:
                    yield block(pa.Table.from_batches(held))
                    held, size = [], 0
        if size:
            yield block(pa.Table.from_batches(held))

    return rows.where(F.size("embedding") == PARTS * width).mapInArrow(tidily(run), STATE)


def _again(blocks: DataFrame, codebooks: np.ndarray, drift: np.ndarray) -> DataFrame:
    """Blocks after another assignment."""
    entries, width = codebooks.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                one = batch.slice(at, 1)
                block = Block.unpack({c: one.column(c)[0].as_py() for c in ("n", "vectors", "members", "offsets", "keys")}, entries, width)
                block.assign(codebooks, drift, first=False)
                yield block.pack(one.column("ids").flatten(), one.column("labels").flatten())

    return blocks.mapInArrow(tidily(run), STATE)


def _gained(blocks: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """(parts, entries, width + 1) of Python integers: the sum of all deltas. A task adds up its own before they are shuffled."""
    parts, entries, size = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * entries * size, np.int64)
        for batch in batches:
            for delta in batch.column(0):
                total += np.frombuffer(delta.as_py(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "gain"])

    sums = blocks.select("delta").mapInArrow(run, "at long, gain long").groupBy("at").agg(F.sum(F.col("gain").cast("decimal(38,0)")).alias("gain"))
    out = np.zeros(parts * entries * size, object)
    for row in sums.collect():
        out[row["at"]] = int(row["gain"])
    return out.reshape(shape)


def learn(spark: SparkSession, rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Blocks of the usable rows, assigned to the last codebooks, and these."""
    codebooks = first_entries(rows, entries)
    parts, entries, width = codebooks.shape
    blocks = stored(_begin(rows, codebooks), "blocks")
    drift = np.zeros((parts, entries))
    totals = np.zeros((parts, entries, width + 1), object)
    for _ in range(rounds if entries else 0):
        totals = totals + _gained(blocks, totals.shape)
        used = totals[:, :, -1] > 0
        moved = codebooks.copy()
        moved[used] = (totals[used][:, :-1] // totals[used][:, -1:]).astype(np.int64)
        step = np.sqrt(((moved - codebooks) ** 2).sum(axis=2).astype(float)) * (1 + MARGIN)
        for part in range(parts):
            for e in range(entries):
                drift[part, e] += step[part, e] + (np.delete(step[part], e).max() if entries > 1 else 0)
        drift *= 1 + MARGIN
        codebooks, before = moved, blocks
        blocks = stored(_again(before, codebooks, drift), "blocks")
        release(before)
    return blocks, codebooks


def _coded(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of each vector."""
    entries, width = codebooks.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                one = batch.slice(at, 1)
                block = Block.unpack({c: one.column(c)[0].as_py() for c in ("n", "vectors", "members", "offsets", "keys")}, entries, width)
                codes, error = block.codes(), np.zeros(len(block.vectors), np.int64)
                for part in range(PARTS):
                    error += ((block.vectors[:, part] - codebooks[part][codes[:, part]]) ** 2).sum(axis=1)
                shown = [line.tobytes().hex() for line in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("labels").flatten(), pa.array(shown), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.select("n", "ids", "labels", "vectors", "members", "offsets", "keys").mapInArrow(tidily(run), "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of the usable vectors, stored, and the codebooks (parts, entries, width). entries: 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits")
    spark = vectors.sparkSession
    ship(spark)
    blocks, codebooks = learn(spark, usable(vectors), entries, rounds)
    coded = stored(_coded(blocks, codebooks), "codes")
    release(blocks)
    return coded, codebooks


def restored(codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """The vectors that codes (n, parts) stand for."""
    parts = [(codebooks[p][codes[:, p]] + 0.5) / SCALE for p in range(codebooks.shape[0])]
    return np.concatenate(parts, axis=1)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of errors over rows of the same label; sums combine in each task, and few labels are broadcast."""
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "labels")
    return coded.join(modest(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    coded, codebooks = compress(table(spark, sf_dir, "embeddings"))
    shown = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(shown).alias("codebooks_sha256"))


def _sql() -> str:
    width = f"(len(v) // {PARTS})"
    steps = [
        f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS n, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (SELECT n, p, list_slice(v, p * {width} + 1, (p + 1) * {width}) AS v FROM kept, range({PARTS}) r(p)),
book0 AS (SELECT p, n - 1 AS e, v FROM pieces WHERE n <= {ENTRIES})"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""
near{k} AS (
  SELECT n, p, any_value(x.v) AS v, min(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {ENTRIES} + e) AS best
  FROM pieces x JOIN book{k} b USING (p) GROUP BY n, p)""")
        if k < ROUNDS:
            steps.append(f"""
sums{k} AS (
  SELECT p, best % {ENTRIES} AS e, i, ((sum(v[i]) - (sum(v[i]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS x
  FROM near{k}, range(1, 1 + (SELECT any_value(len(v)) FROM pieces)) r(i) GROUP BY p, best % {ENTRIES}, i),
book{k + 1} AS (
  SELECT p, e, coalesce(s.v, b.v) AS v FROM book{k} b LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM sums{k} GROUP BY p, e) s USING (p, e))""")
    last = f"""
coded AS (
  SELECT n, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM near{ROUNDS} GROUP BY n),
shown AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (n), shown
"""
    return ",".join(steps) + "," + last


ORACLE = _sql()
