"""Page rasters: ink profiles, column separators and boxes.

A raster is a row: id, samples (8 bits each, row by row) and width; samples that don't
fill a last row don't count. Arrow batches of rasters become rows of runs of ink or of
boxes, which are small; all that follows is grouping and windows by raster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples below are ink.
INK = 128
# Where a separator is looked for, how wide the profile is smoothed, and what is a letter's box.
FROM, TO, SMOOTH = 0.35, 0.65, 0.02
TOP, WIDE, TALL, TALLEST = 0.4, 0.20, 40, 0.25
# Weights of small kernels, by their size.
KERNELS = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}

_RUNS = "id string, y int, x0 int, x1 int"
_BOXES = "id string, x int, y int, w int, h int"


def _image(samples: bytes, width: int, ink: int) -> np.ndarray:
    """(height, width): where there is ink."""
    height = len(samples) // width if width and width > 0 else 0
    return np.frombuffer(samples, np.uint8)[: height * (width or 0)].reshape(height, width or 0) < ink


def _spans(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1) of each run of ink, end exclusive, row by row."""
    edges = np.diff(np.pad(image, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, x0 = np.nonzero(edges == 1)
    return y, x0, np.nonzero(edges == -1)[1]


def _boxes(image: np.ndarray) -> np.ndarray:
    """(x, y, w, h) of each connected piece of ink; runs that touch, corners included, are one piece."""
    y, x0, x1 = _spans(image)
    root = list(range(len(y)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    starts = np.searchsorted(y, np.arange(image.shape[0] + 1)).tolist()
    left, right = x0.tolist(), x1.tolist()
    for row in range(1, image.shape[0]):
        above, below, end = starts[row - 1], starts[row], starts[row + 1]
        while above < starts[row] and below < end:
            if left[above] <= right[below] and left[below] <= right[above]:
                root[find(below)] = find(above)
            if right[above] < right[below]:
                above += 1
            else:
                below += 1
    piece = np.array([find(i) for i in range(len(y))], np.int64)
    kinds, of = np.unique(piece, return_inverse=True)
    out = np.zeros((len(kinds), 4), np.int64)
    low = np.full((len(kinds), 2), np.iinfo(np.int64).max)
    high = np.zeros((len(kinds), 2), np.int64)
    np.minimum.at(low, of, np.stack([x0, y], axis=1))
    np.maximum.at(high, of, np.stack([x1, y + 1], axis=1))
    out[:, :2], out[:, 2:] = low, high - low
    return out


def _mapped(rasters: DataFrame, ink: int, schema: str, make) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, samples, width in zip(*batch.columns, strict=True):
                columns = make(_image(samples.as_py() or b"", width.as_py(), ink))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(columns[0]), pa.string()), *[pa.array(c, pa.int32()) for c in columns]], names)

    return rasters.select(F.col("id").cast("string").alias("id"), "samples", F.col("width").cast("int").alias("width")).mapInArrow(run, schema)


def runs(rasters: DataFrame, ink: int = INK) -> DataFrame:
    """(id, y, x0, x1) of each run of ink."""
    return _mapped(rasters, ink, _RUNS, _spans)


def _profiles(rasters: DataFrame, ink: int) -> DataFrame:
    """(id, width, profile): a raster's ink by column, counted where the raster is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_pylist()
            found = [_image(samples.as_py() or b"", w, ink).sum(axis=0) if w and w > 0 else [] for samples, w in zip(batch.column("samples"), width, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("width"), pa.array(found, pa.list_(pa.int64()))], ["id", "width", "profile"])

    given = rasters.select(F.col("id").cast("string").alias("id"), "samples", F.col("width").cast("int").alias("width"))
    return given.mapInArrow(run, "id string, width int, profile array<long>")


def profile(rasters: DataFrame, ink: int = INK) -> DataFrame:
    """(id, x, ink): how many samples of each column are ink."""
    return _profiles(rasters, ink).select("id", F.posexplode("profile").alias("x", "ink"))


def _weights(size: Column) -> Column:
    """Those of a kernel over `size` values, an odd number."""
    half = ((size - 1) / 2).cast("int")
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    bell = F.transform(F.sequence(-half, half), lambda d: F.exp(-(d * d) / (2 * sigma * sigma)))
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    small = F.create_map(*[F.lit(x) for k, w in KERNELS.items() for x in (k, w)])
    return F.coalesce(F.try_element_at(small, size), F.transform(bell, lambda w: w / total(bell)))


def _smoothed(values: Column, weights: Column) -> Column:
    """Weighted means; the ends are mirrored. Both are columns that stand ready, as each value reads them again."""
    n, half = F.size(values), F.floor(F.size(weights) / 2).cast("int")
    at = lambda i: F.element_at(values, F.when(i < 0, -i).when(i > n - 1, 2 * (n - 1) - i).otherwise(i) + 1)
    mean = lambda i: F.aggregate(F.transform(weights, lambda w, k: at(i + k - half) * w), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), n - 1), mean)


def separator(rasters: DataFrame, ink: int = INK) -> DataFrame:
    """(id, x): the column between 35 and 65 % of the width with the least ink, smoothed over 2 % of it; of equal ones the first. Null where there is no such column."""
    begin, end = (F.floor(F.col("width") * x).cast("int") for x in (FROM, TO))
    rows = _profiles(rasters, ink).select("id", "width", begin.alias("begin"), F.when(end > begin, F.slice("profile", begin + 1, end - begin).cast("array<double>")).alias("p"))
    size = F.floor(F.col("width") * SMOOTH)
    odd = F.least(F.when(size % 2 == 0, size + 1).otherwise(size), 2 * F.size("p") - 1).cast("int")
    rows = rows.withColumn("weights", _weights(odd))
    means = _smoothed(F.col("p"), F.col("weights"))
    best = F.array_min(F.transform(means, lambda v, i: F.struct(F.round(v, 9).alias("v"), i.alias("i"))))
    return rows.select("id", F.when(F.size("p") > 0, F.col("begin") + best["i"]).alias("x"))


def boxes(rasters: DataFrame, ink: int = INK) -> DataFrame:
    """(id, x, y, w, h) of each connected piece of ink."""
    return _mapped(rasters, ink, _BOXES, lambda image: tuple(_boxes(image).T))


def letter_box(rasters: DataFrame, ink: int = INK, tall: int = TALL) -> DataFrame:
    """(id, box): the largest piece in the upper part that is wide and not too high; null if there is none."""
    sized = rasters.select(F.col("id").cast("string").alias("id"), F.col("width").cast("int").alias("width"), F.floor(F.octet_length("samples") / F.col("width")).alias("height"))
    fits = (F.col("y") < F.col("height") * TOP) & (F.col("w") > F.col("width") * WIDE) & (F.col("h") > tall) & (F.col("h") < F.col("height") * TALLEST)
    area = F.struct((F.col("w") * F.col("h")).alias("area"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
    found = boxes(rasters, ink).join(sized, "id").where(fits).groupBy("id").agg(F.max_by(F.struct("x", "y", "w", "h"), area).alias("box"))
    return sized.select("id").join(found, "id", "left")
