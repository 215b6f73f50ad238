"""Pixels: numpy over whole images, in Arrow batches. Images are dense bytes, four to a pixel, blue first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ready
from .framediff import CELL

# Fixed value: blur's standard deviation in pixels.
SIGMA = 25.0


def image(data: bytes, width: int, height: int, longer: bool = False) -> np.ndarray:
    """(height, width, 4); a buffer of another size raises ValueError, with ``longer`` only a shorter one."""
    data = data[: width * height * 4] if longer else data
    if len(data) != width * height * 4:
        raise ValueError(f"buffer has {len(data)} bytes, {width} x {height} needs {width * height * 4}")
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)


def swapped(pixels: np.ndarray) -> np.ndarray:
    """Red and blue exchanged: BGRA to RGBA and back."""
    return pixels[..., [2, 1, 0, 3]]


def luma(bgra: np.ndarray) -> np.ndarray:
    b, g, r = (bgra[..., i].astype(np.uint32) for i in range(3))
    return ((299 * r + 587 * g + 114 * b) // 1000).astype(np.uint8)


def blurred(pixels: np.ndarray, boxes: list[tuple[int, int, int, int]], sigma: float = SIGMA) -> np.ndarray:
    """A copy with the boxes blurred in the given order, by a separable Gaussian that repeats edge pixels."""
    out = pixels.copy()
    reach = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for x, y, w, h in boxes:
        part = out[y : y + h, x : x + w].astype(np.float64)
        for axis in (0, 1):
            wide = np.pad(part, [(reach, reach) if a == axis else (0, 0) for a in range(3)], mode="edge")
            run = np.lib.stride_tricks.sliding_window_view(wide, len(kernel), axis=axis)
            part = run @ kernel
        out[y : y + h, x : x + w] = np.clip(np.rint(part), 0, 255).astype(np.uint8)
    return out


def letterboxed(bgra: np.ndarray, target: int) -> np.ndarray:
    """(3, target, target): red, green and blue in 0 to 1, nearest pixels, zero around."""
    height, width = bgra.shape[:2]
    s = np.float32(target) / np.float32(max(width, height))
    new_w, new_h = int(np.float32(width) * s), int(np.float32(height) * s)
    px, py = (target - new_w) // 2, (target - new_h) // 2
    sy = np.minimum((np.arange(new_h, dtype=np.float32) / s).astype(int), height - 1)
    sx = np.minimum((np.arange(new_w, dtype=np.float32) / s).astype(int), width - 1)
    out = np.zeros((3, target, target), np.float32)
    out[:, py : py + new_h, px : px + new_w] = (bgra[sy][:, sx][..., [2, 1, 0]].astype(np.float32) / np.float32(255)).transpose(2, 0, 1)
    return out


def downscaled(rgba: np.ndarray, width: int, height: int) -> np.ndarray:
    """(height, width) of 0x00RRGGBB by nearest pixels."""
    sh, sw = rgba.shape[:2]
    p = rgba[(np.arange(height) * sh) // height][:, (np.arange(width) * sw) // width].astype(np.uint32)
    return p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]


def outlined(rgba: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """A copy with three nested hollow rectangles around each box, as far as they are inside."""
    out = rgba.copy()
    height, width = out.shape[:2]
    for x, y, w, h in boxes:
        for d in (-1, 0, 1):
            x0, y0 = x + d, y + d
            x1, y1 = x0 + max(w, 1) - 1, y0 + max(h, 1) - 1
            rows, cols = slice(max(y0, 0), max(min(y1 + 1, height), 0)), slice(max(x0, 0), max(min(x1 + 1, width), 0))
            for at in (y0, y1):
                if 0 <= at < height:
                    out[at, cols] = (255, 56, 56, 255)
            for at in (x0, x1):
                if 0 <= at < width:
                    out[rows, at] = (255, 56, 56, 255)
    return out


def cell_grid(bgra: np.ndarray, cell: int = CELL) -> np.ndarray:
    """(rows, cols) of FNV-1a over each cell's bytes from top to bottom; cells at the rim are smaller."""
    height, width = bgra.shape[:2]
    rows, cols = -(-height // cell), -(-width // cell)
    h = np.full((rows, cols), 0xCBF29CE484222325, np.uint64)
    prime = np.uint64(0x100000001B3)
    flat = bgra.reshape(height, width * 4)
    for dy in range(min(cell, height)):  # all cells take their next byte together
        y = np.arange(dy, height, cell)
        for dx in range(min(cell, width) * 4):
            x = np.arange(dx, width * 4, cell * 4)
            part = h[: len(y), : len(x)]
            h[: len(y), : len(x)] = (part ^ flat[np.ix_(y, x)]) * prime
    return h


def cell_hashes(frames: DataFrame, cell: int = CELL) -> DataFrame:
    """Frames -> (stream_id, frame_idx, cy, cx, hash): the cells' hashes as 16 hexadecimal digits."""
    ready(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, f, w, h, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                g = cell_grid(image(data, w, h), cell)
                cy, cx = (a.ravel().astype(np.int32) for a in np.indices(g.shape))
                yield pa.record_batch([pa.array([s] * g.size, pa.int64()), pa.array([f] * g.size, pa.int64()), pa.array(cy), pa.array(cx), pa.array([f"{int(v):016x}" for v in g.ravel()], pa.string())], ["stream_id", "frame_idx", "cy", "cx", "hash"])

    from ..schemas import CELL_HASHES

    return frames.select("stream_id", "frame_idx", "width", "height", "bgra").mapInArrow(run, CELL_HASHES)


def map_frames(frames: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Frames with their pixels changed by a function of (height, width, 4) bytes; bgra takes what it returns, as bytes."""
    ready(frames.sparkSession)
    names = frames.columns
    at = [names.index(c) for c in ("width", "height", "bgra")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            cols[at[2]] = pa.array([change(image(d, w, h)).tobytes() for w, h, d in zip(*(b.column(i).to_pylist() for i in at), strict=True)], pa.binary())
            yield pa.record_batch(cols, names)

    return frames.mapInArrow(run, frames.schema)


def blur_frames(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """Frames with their regions (stream_id, frame_idx, x, y, w, h) blurred; regions in order of (y, x, h, w)."""
    from pyspark.sql import functions as F

    ready(frames.sparkSession)
    keys = ["stream_id", "frame_idx"]
    boxes = regions.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("y", "x", "h", "w"))).alias("boxes"))
    both = frames.join(boxes, keys, "left").select(*frames.columns, "boxes")
    names = frames.columns
    at = [names.index(c) for c in ("width", "height", "bgra")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, h, data, found in zip(*(b.column(i).to_pylist() for i in (*at, b.num_columns - 1)), strict=True):
                out.append(blurred(image(data, w, h), [(r["x"], r["y"], r["w"], r["h"]) for r in found]).tobytes() if found else data)
            cols = list(b.columns[:-1])
            cols[at[2]] = pa.array(out, pa.binary())
            yield pa.record_batch(cols, names)

    return both.mapInArrow(run, frames.schema)
