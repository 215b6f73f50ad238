"""Boxes: quantising, padding, overlap, letterbox and label geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
GRID = 4
PAD_X, PAD_Y = 24, 16


def f32(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def quantised(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corner down and size up to the grid, each by itself."""
    down = lambda v: (v - v % GRID).cast("long")
    up = lambda v: (F.floor((v + GRID - 1) / GRID) * GRID).cast("long")
    return F.struct(down(x).alias("x"), down(y).alias("y"), up(w).alias("w"), up(h).alias("h"))


def blur_region(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The box cut to the frame and padded; what the frame's edge cuts off isn't made up for."""

    def axis(at: Column, size: Column, whole: Column, pad: int) -> tuple[Column, Column]:
        at = F.least(at, F.greatest(whole - 1, F.lit(0)))
        size = F.greatest(F.least(size, F.greatest(whole - at, F.lit(0))), F.lit(1))
        start = F.greatest(at - pad, F.lit(0))
        return start, F.least(size + 2 * pad, whole - start)

    (px, pw), (py, ph) = axis(x, w, width, PAD_X), axis(y, h, height, PAD_Y)
    return F.struct(px.cast("long").alias("x"), py.cast("long").alias("y"), pw.cast("long").alias("w"), ph.cast("long").alias("h"))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes over their union, in single precision; 0 without overlap."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inter = f32(w * h)
    union = (f32(a["w"] * a["h"]) + f32(b["w"] * b["h"])) - inter
    return F.when((w <= 0) | (h <= 0) | (union <= 0), f32(0.0)).otherwise(f32(inter / union))


def letterbox(width: Column, height: Column, target: int) -> Column:
    """(scale, new_w, new_h, pad_x, pad_y) that fit a frame into a square."""
    scale = f32(f32(target) / f32(F.greatest(width, height)))
    new_w, new_h = (f32(width) * scale).cast("int"), (f32(height) * scale).cast("int")
    pad = lambda n: F.floor((F.lit(target) - n) / 2).cast("int")
    return F.struct(scale.alias("scale"), new_w.alias("new_w"), new_h.alias("new_h"), pad(new_w).alias("pad_x"), pad(new_h).alias("pad_y"))


def preview_size(width: Column, height: Column, most: int) -> Column:
    w = F.least(F.lit(most), width)
    return F.struct(w.cast("int").alias("w"), (f32(height) * f32(f32(w) / f32(width))).cast("int").alias("h"))
