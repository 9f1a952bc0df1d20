"""Pairs of vectors whose cosine reaches a threshold: exact, without comparing all.

Of unit vectors a cosine of c is a distance of sqrt(2 - 2c), so the triangle
inequality bounds it. A few pivots (PIVOTS at most, chosen by hash; they only steer the
work) split the vectors on the right into cells by the nearest pivot, and cells into
rings by the distance to it. A ring is a block, with the least and the greatest of
its distances; of blocks there are PIVOTS * RINGS at most, so their bounds are a small
table that every task holds. A vector x on the left is sent only to blocks that can
hold a vector within reach e of it:

* d(x, pivot) lies within e of the block's distances, and
* (d(x, pivot) - d(x, nearest pivot)) / 2 <= e, as all of the cell are nearer to its
  pivot than to any other.

Both bounds are taken with a slack beyond any rounding, so none of the pairs is lost.
Blocks of more than BLOCK vectors, of equal ones for example, are dealt to parts, each
compared by one task. Where bounds don't prune (vectors in all directions, a low
threshold), the work is that of all pairs, and visits to small blocks would send each
vector as often as there are blocks. So if the pivots, as a sample, would visit more than
VISITS parts on average, both sides are dealt by hash to a grid of tasks instead: a part
holds HELD vectors at most, and a vector is sent to a row or a column of the grid.
`comparisons` tells the work beforehand.

Candidates are found with single-precision products, whose error has a bound, and each
is decided by its cosine in doubles, summed in the order of the components.

Null and zero vectors are near none, nor are vectors of another length than the pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.sources.tables import stored

PIVOTS, RINGS, BLOCK = 64, 16, 2000
#: Parts that a vector visits on average before a grid takes the place of blocks, its least columns, its rows, and the vectors of a part.
VISITS, COLUMNS, GROUPS, HELD = 24, 8, 8, 16384
#: Products that a task has in memory at once.
CELLS = 1 << 22
#: Of distances and cosines: far beyond the rounding of doubles.
SLACK = 1e-7

_HOME = "cell int, dist double, id string, embedding array<double>"
_MOVED = "block int, part int, side int, id string, embedding array<double>"
_PAIR = "left string, right string, similarity double"


def _sound(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a direction, and their vectors."""
    held = [(n, value) for n, value in enumerate(column.to_pylist()) if value and len(value) == dim and None not in value]
    if not held:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    rows, values = np.array([n for n, _ in held]), np.array([value for _, value in held], float)
    size = np.sqrt((values * values).sum(axis=1))
    good = (size > 0) & np.isfinite(size)
    return rows[good], values[good]


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a direction, and these as unit vectors."""
    rows, values = _sound(column, dim)
    return rows, values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows in the order of their components, as `functions.vectors` sums them."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _apart(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * units @ pivots.T, 0))


class Blocks:
    """The blocks of the vectors on the right, and which of them a vector can reach."""

    def __init__(self, right: DataFrame, pivots: int, rings: int, block: int):
        sound = right.where("embedding is not null").select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        n = sound.count()
        wanted = max(1, min(pivots, 4 * n // block))
        chosen = sound.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
        self.dim = len(chosen[0].embedding) if chosen else 0
        units = [_matrix(pa.array([r.embedding]), self.dim)[1] for r in chosen]
        self.pivots = np.concatenate([u for u in units if len(u)]) if any(len(u) for u in units) else np.zeros((0, self.dim))
        if not len(self.pivots):
            self.home, self.bounds, self.grid = None, np.zeros((0, 5)), 0
            return
        dim, points = self.dim, self.pivots

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = _matrix(batch.column(1), dim)
                apart = _apart(found, points)
                cell = apart.argmin(axis=1)
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(rows)), cell]), batch.column(0).take(taken), batch.column(1).take(taken)], ["cell", "dist", "id", "embedding"]
                )

        settled = stored(sound.mapInArrow(settle, _HOME), "cells")
        # As many rings as keep blocks from being small; their limits are quantiles of the distances.
        count = F.count("*").alias("n")
        cells = settled.groupBy("cell").agg(count, F.percentile_approx("dist", [k / rings for k in range(1, rings)], 1000).alias("cuts")).collect() if rings > 1 else []
        steps = {r.cell: r.cuts[:: max(1, -(-rings * block // r.n))] if r.n > block else [] for r in cells}
        limits = [F.lit([float(x) for x in steps.get(c, [])]).cast("array<double>") for c in range(len(points))]
        ring = F.size(F.filter(F.element_at(F.array(*limits), F.col("cell") + 1), lambda x: x < F.col("dist")))
        self.home = settled.withColumn("ring", ring)
        rows = self.home.groupBy("cell", "ring").agg(F.min("dist"), F.max("dist"), count).collect()
        #: cell, least and greatest distance, parts, vectors; a row for each block.
        self.bounds = np.array(sorted([r[0], r[2], r[3], -(-r[4] // block), r[4], r[1]] for r in rows), float)
        numbers = F.create_map(*[F.lit(x) for n, b in enumerate(self.bounds.tolist()) for x in (int(b[0]) * rings + int(b[5]), F.struct(F.lit(n).alias("block"), F.lit(int(b[3])).alias("parts")))])
        at = self.home.withColumn("_at", F.element_at(numbers, F.col("cell") * rings + F.col("ring")))
        self.home = at.select(F.col("_at.block").alias("block"), F.pmod(F.xxhash64("id"), F.col("_at.parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "embedding")
        #: Columns of the grid, should bounds not prune.
        self.grid = max(COLUMNS, -(-n // HELD))

    def visits(self, reach: float) -> float:
        """How many parts a vector visits on average; the pivots are the sample."""
        return float((self.reached(self.pivots, reach) @ self.bounds[:, 3]).mean())

    def reached(self, units: np.ndarray, reach: float) -> np.ndarray:
        """(vectors, blocks): which blocks can hold a vector within reach."""
        apart = _apart(units, self.pivots)
        cell = self.bounds[:, 0].astype(int)
        own = apart[:, cell]
        inside = (own >= self.bounds[:, 1] - reach - SLACK) & (own <= self.bounds[:, 2] + reach + SLACK)
        return inside & ((own - apart.min(axis=1, keepdims=True)) / 2 <= reach + SLACK)


def _visits(left: DataFrame, blocks: Blocks, reach: float) -> DataFrame:
    dim, parts = blocks.dim, blocks.bounds[:, 3].astype(int)
    reached = blocks.reached

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 512):
                some = batch.slice(begin, 512)
                rows, units = _matrix(some.column(1), dim)
                who, block = np.nonzero(reached(units, reach))
                times = parts[block]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                taken = pa.array(rows[np.repeat(who, times)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(block, times), pa.int32()), pa.array(part, pa.int32()), pa.array(np.ones(len(part)), pa.int32()), some.column(0).take(taken), some.column(1).take(taken)],
                    ["block", "part", "side", "id", "embedding"],
                )

    home = Blocks.__new__(Blocks)  # what tasks need of it, without DataFrames
    home.pivots, home.bounds = blocks.pivots, blocks.bounds
    reached = home.reached
    return left.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, _MOVED)


def _dealt(left: DataFrame, home: DataFrame, columns: int) -> DataFrame:
    """Both sides on a grid: those on the right are in a column, in each group of it; those on the left are in a group of each column."""
    at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.array(*[F.lit(k) for k in range(n)]))
    asked = left.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    held = home.select(at(columns).alias("block"), each(GROUPS).alias("part"), F.lit(0).alias("side"), "id", "embedding")
    return held.unionByName(asked.select(each(columns).alias("block"), at(GROUPS).alias("part"), F.lit(1).alias("side"), "id", "embedding"))


def _met(least: float, dim: int):
    """Sorted rows to pairs: the vectors of a part come first and are held, those that visit it stream by."""
    narrow = (dim + 8) * 1.2e-7  # beyond the error of products in single precision

    def sides(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        rows, values = _sound(column, dim)
        size = np.sqrt(_dot(values, values))
        return pa.array(rows, pa.int64()), values, size, (values / size[:, None]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, there, pending = None, None, []
        for batch in batches:
            key = batch.column("block").to_numpy().astype(np.int64) << 33 | batch.column("part").to_numpy().astype(np.int64) << 1 | batch.column("side").to_numpy()
            ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(batch)]
            for begin, end in zip([0, *ends], ends, strict=False):
                some = batch.slice(begin, end - begin)
                block, visiting = int(key[begin]) >> 1, bool(key[begin] & 1)
                if block != at:
                    at, pending, there = block, [], None
                if not visiting:
                    rows, *held = sides(some.column("embedding"))
                    pending.append((some.column("id").take(rows), *held))
                    continue
                if there is None and pending:
                    ids, *held = zip(*pending, strict=True)
                    there, pending = (pa.concat_arrays(ids), *[np.concatenate(h) for h in held]), []
                if there is None or not len(there[1]):
                    continue
                ids, values, size, units = there
                rows, mine, length, wide = sides(some.column("embedding"))
                names = some.column("id").take(rows)
                step = max(1, CELLS // len(units))
                for low in range(0, len(mine), step):
                    who, whom = np.divmod(np.flatnonzero((wide[low : low + step] @ units.T).ravel() >= least - narrow), len(units))
                    for k in range(0, len(who), 65536):
                        a, b = who[k : k + 65536] + low, whom[k : k + 65536]
                        near = _dot(mine[a], values[b]) / (length[a] * size[b])
                        good = near >= least
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(a[good])), ids.take(pa.array(b[good])), pa.array(near[good])], ["left", "right", "similarity"])

    return run


def within(left: DataFrame, right: DataFrame, threshold: float, pivots: int = PIVOTS, rings: int = RINGS, block: int = BLOCK) -> DataFrame:
    """(left, right, similarity) of all pairs of ids whose vectors have at least this cosine; both tables: id, embedding."""
    blocks = Blocks(right, pivots, rings, block)
    if blocks.home is None:
        return left.sparkSession.createDataFrame([], "left string, right string, similarity double")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    both = _dealt(left, blocks.home, blocks.grid) if blocks.visits(reach) > VISITS else blocks.home.unionByName(_visits(left, blocks, reach))
    return both.repartition("block", "part").sortWithinPartitions("block", "part", "side").mapInArrow(_met(threshold, blocks.dim), _PAIR)


def comparisons(left: DataFrame, right: DataFrame, threshold: float, pivots: int = PIVOTS, rings: int = RINGS, block: int = BLOCK) -> int:
    """How many pairs `within` compares: all pairs less those that bounds rule out."""
    blocks = Blocks(right, pivots, rings, block)
    if blocks.home is None:
        return 0
    visits = _visits(left, blocks, float(np.sqrt(max(0.0, 2 - 2 * threshold)))).where("part = 0").groupBy("block").agg(F.count("*").alias("n"))
    return int(sum(r.n * blocks.bounds[r.block, 4] for r in visits.collect()))
