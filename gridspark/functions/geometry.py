"""Boxes as struct columns ``x0, y0, x1, y1`` with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def bbox(x0, y0, x1, y1) -> Column:
    values = (x if isinstance(x, Column) else F.lit(x) if not isinstance(x, str) else F.col(x) for x in (x0, y0, x1, y1))
    return F.struct(*[v.cast("double").alias(s) for v, s in zip(values, SIDES, strict=True)])


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def intersection_area(a: Column, b: Column) -> Column:
    """Zero where the boxes only touch or lie apart."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w < 0) | (h < 0), F.lit(0.0)).otherwise(w * h)


def union_area(a: Column, b: Column) -> Column:
    return area(a) + area(b) - intersection_area(a, b)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for a null box and for an empty union."""
    return F.coalesce(F.try_divide(intersection_area(a, b), union_area(a, b)), F.lit(0.0))


def containment(inner: Column, outer: Column) -> Column:
    """The share of ``inner`` that lies in ``outer``: what a small box in a large one is better matched by than by IoU."""
    return F.coalesce(F.try_divide(intersection_area(inner, outer), area(inner)), F.lit(0.0))


def overlaps(a: Column, b: Column) -> Column:
    """A sargable necessary condition for a positive intersection."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def looks_normalized(b: Column) -> Column:
    return b["x0"].between(0, 1) & b["y0"].between(0, 1) & (b["x1"] > 0) & (b["x1"] <= 1) & (b["y1"] > 0) & (b["y1"] <= 1)


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels, cut towards zero and clamped to the page; a box inside the unit square is taken as normalised."""

    def side(name: str, size: Column) -> Column:
        v = F.when(looks_normalized(b), b[name] * size).otherwise(b[name]).cast("bigint")
        return F.greatest(F.lit(0), F.least(v, size.cast("bigint"))).cast("int").alias(name)

    return F.struct(side("x0", width), side("y0", height), side("x1", width), side("y1", height))


def normalize(b: Column, width: Column, height: Column) -> Column:
    return bbox(b["x0"] / width, b["y0"] / height, b["x1"] / width, b["y1"] / height)


def points_to_pixels(b: Column, dpi: Column) -> Column:
    k = dpi / 72.0
    return bbox(b["x0"] * k, b["y0"] * k, b["x1"] * k, b["y1"] * k)


def pad_and_clamp(b: Column, pad: Column, width: Column, height: Column) -> Column:
    zero = F.lit(0.0)
    return bbox(F.greatest(zero, b["x0"] - pad), F.greatest(zero, b["y0"] - pad), F.least(width, b["x1"] + pad), F.least(height, b["y1"] + pad))


def split_cell(b: Column, r: Column, c: Column, n_rows: Column, n_cols: Column) -> Column:
    """Cell (r, c) of the even division of a box."""
    w, h = (b["x1"] - b["x0"]) / n_cols, (b["y1"] - b["y0"]) / n_rows
    return bbox(b["x0"] + c * w, b["y0"] + r * h, b["x0"] + (c + 1) * w, b["y0"] + (r + 1) * h)


def band(width: Column, height: Column, i: Column, n: Column) -> Column:
    """The i-th of n equal bands of a page, from the top."""
    h = height / n
    return bbox(F.lit(0.0), i * h, width, (i + 1) * h)
