"""Boxes: structs x, y, w, h in page coordinates from 0 to 1, top left origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PADDING = 0.004


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def padded_bounds(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Aggregate: the box around lines, with padding, inside the page."""
    x0, y0, x1, y1 = F.min(x), F.min(y), F.max(x + w), F.max(y + h)
    zero, one = F.lit(0.0), F.lit(1.0)
    return box(F.greatest(zero, x0 - PADDING), F.greatest(zero, y0 - PADDING), F.least(one, x1 - x0 + 2 * PADDING), F.least(one, y1 - y0 + 2 * PADDING))


def union_bounds(b: Column) -> Column:
    """Aggregate: the box around boxes; nulls don't count."""
    x0, y0 = F.min(b["x"]), F.min(b["y"])
    return F.when(F.count(b) > 0, box(x0, y0, F.max(b["x"] + b["w"]) - x0, F.max(b["y"] + b["h"]) - y0))


def holds_centre(b: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Whether a line's centre lies in a box."""
    cx, cy = x + w / 2, y + h / 2
    return F.coalesce(cx.between(b["x"], b["x"] + b["w"]) & cy.between(b["y"], b["y"] + b["h"]), F.lit(False))


def flipped(y: Column, h: Column) -> Column:
    """From a bottom left to a top left origin."""
    return 1 - y - h


def points(b: Column, width: Column, height: Column) -> Column:
    """In points, inside the page; null without area."""
    x0, y0 = F.greatest(F.lit(0.0), b["x"] * width), F.greatest(F.lit(0.0), b["y"] * height)
    x1, y1 = F.least(width, (b["x"] + b["w"]) * width), F.least(height, (b["y"] + b["h"]) * height)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
