"""Profiles, separators and boxes of rasters against loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lexispark.operators import raster

SCHEMA = "id string, samples binary, width int"


def pieces(image):
    """Bounding boxes by walking from pixel to pixel."""
    left = {(y, x) for y, x in zip(*np.nonzero(image), strict=True)}
    out = []
    while left:
        walk, seen = [left.pop()], []
        while walk:
            y, x = walk.pop()
            seen.append((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            walk += near
        ys, xs = zip(*seen, strict=True)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    return sorted(map(lambda b: tuple(int(v) for v in b), out))


def least(sums, width):
    begin, end = int(width * 0.35), int(width * 0.65)
    inner = [float(x) for x in sums[begin:end]]
    if not inner:
        return None
    k = int(width * 0.02)
    k += k % 2 == 0
    half = k // 2
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    weights = raster.KERNELS.get(k) or [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-half, half + 1)]
    n = len(inner)
    mirror = lambda i: -i if i < 0 else 2 * (n - 1) - i if i > n - 1 else i
    means = [round(sum(inner[mirror(i + d)] * w for d, w in zip(range(-half, half + 1), weights, strict=True)) / sum(weights), 9) for i in range(n)]
    return begin + means.index(min(means))


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(5)
    out = {f"{w}x{h}": np.where(rng.random((h, w)) < 0.35, 0, 255).astype(np.uint8) for w, h in ((64, 40), (256, 9), (700, 5), (1, 3), (3, 1))}
    page = np.full((400, 300), 255, np.uint8)
    page[20:70, 100:200] = 0
    page[30:60, 110:190] = 255  # a frame
    page[200:300, 10:290] = 0  # too low and too high
    page[90:140, 20:100] = 50
    return out | {"page": page, "blank": np.full((4, 50), 255, np.uint8)}


@pytest.fixture(scope="module")
def rasters(spark, images):
    rows = [(name, image.tobytes() + b"\0" * (name == "page"), image.shape[1]) for name, image in images.items()]
    return spark.createDataFrame([*rows, ("null", None, 5), ("none", b"", 5), ("no width", b"abc", None)], SCHEMA)


def test_profile_and_separator(rasters, images):
    sums = {}
    for r in raster.profile(rasters).collect():
        sums.setdefault(r.id, {})[r.x] = r.ink
    for name, image in images.items():
        assert [sums[name][x] for x in range(image.shape[1])] == (image < 128).sum(axis=0).tolist()
    got = {r.id: r.x for r in raster.separator(rasters).collect()}
    assert {name: got[name] for name in images} == {name: least((image < 128).sum(axis=0), image.shape[1]) for name, image in images.items()}
    assert got["no width"] is None


def test_boxes(rasters, images):
    found = {}
    for r in raster.boxes(rasters).collect():
        found.setdefault(r.id, []).append((r.x, r.y, r.w, r.h))
    for name, image in images.items():
        assert sorted(found.get(name, [])) == pieces(image < 128), name
    box = {r.id: r.box for r in raster.letter_box(rasters).collect()}
    assert tuple(box["page"]) == (100, 20, 100, 50)
    assert box["64x40"] is None and box["null"] is None
