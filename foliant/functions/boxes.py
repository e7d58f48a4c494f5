"""Geometry of boxes on a page of 1000 by 1000: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without overlap, negative extents count as 0."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    h = F.greatest(zero, F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    area = lambda x: F.greatest(zero, x.x1 - x.x0) * F.greatest(zero, x.y1 - x.y0)
    union = area(a) + area(b) - w * h
    return F.when((w * h > 0) & (union > 0), w * h / F.greatest(union, F.lit(1e-12))).otherwise(0.0)


def strict_iou(a: Column, b: Column) -> Column:
    """Intersection over union where boxes that only touch do not overlap; tiny unions do not divide by zero."""
    w, h = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    area = lambda x: (x.x1 - x.x0) * (x.y1 - x.y0)
    return F.when((w > 0) & (h > 0), w * h / F.greatest(F.lit(1e-6), area(a) + area(b) - w * h)).otherwise(0.0)


def css(box: Column) -> Column:
    """A box as its place and size in per cent."""
    part = lambda name, v: F.concat(F.lit(f"{name}:"), (v / 10).cast("string"), F.lit("%"))
    return F.concat_ws(";", part("left", box.x0), part("top", box.y0), part("width", box.x1 - box.x0), part("height", box.y1 - box.y0))


def to_pixels(v: Column, size: Column) -> Column:
    """A coordinate in whole pixels, cut towards zero."""
    return (v / 1000 * size).cast("int")


def padded(box: Column, width: Column, height: Column, pad: int = 2) -> list[Column]:
    """The crop of a box in pixels, widened by ``pad`` and kept on the page."""
    return [
        F.greatest(F.lit(0), to_pixels(box.x0, width) - pad).alias("px0"), F.greatest(F.lit(0), to_pixels(box.y0, height) - pad).alias("py0"),
        F.least(width, to_pixels(box.x1, width) + pad).alias("px1"), F.least(height, to_pixels(box.y1, height) + pad).alias("py1"),
    ]


def half_even(x: Column) -> Column:
    return F.bround(x.cast("decimal(20,6)"), 0).cast("bigint")


def fit_to_budget(h: Column, w: Column, factor: int = 32, least: int = 65536, most: int = 1048576) -> tuple[Column, Column]:
    """Height and width as multiples of ``factor`` within the budget of pixels; null if there is no such size."""
    h0, w0 = half_even(h / factor) * factor, half_even(w / factor) * factor
    down = F.sqrt(h * w / F.lit(float(most)))
    up = F.sqrt(F.lit(float(least)) / (h * w))

    def side(x: Column, x0: Column) -> Column:
        v = F.when(h0 * w0 > most, F.floor(x / down / factor) * factor).when(h0 * w0 < least, F.ceil(x * up / factor) * factor).otherwise(x0)
        return F.greatest(F.lit(factor), v).cast("int")

    ok = (h > 0) & (w > 0) & (F.greatest(h, w) / F.greatest(F.least(h, w), F.lit(1)) <= 200)
    return F.when(ok, side(h, h0)), F.when(ok, side(w, w0))
