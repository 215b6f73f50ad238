"""Frames cut into cells: hashes, what changed, and the gate that decides when to recognise text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ready

# Pixels of a cell's side, and frames that may be skipped in a row.
CELL, MOST_SKIPS = 64, 3
KEYS = ["stream_id", "frame_idx"]


def grid(cells: DataFrame, value: str = "hash", keys: list[str] = KEYS) -> DataFrame:
    """Cells (cy, cx, value) -> a frame each: cols, rows and its values row by row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("cy", "cx", value))), lambda c: c[value])
    return cells.groupBy(*keys).agg((F.max("cx") + 1).alias("cols"), (F.max("cy") + 1).alias("rows"), ordered.alias("cells"))


def fraction_changed(now: Column, then: Column) -> Column:
    """Of two grids (cols, rows, cells): the share of cells that differ, 1 if their sizes do, 0 if empty."""
    changed = F.size(F.filter(F.zip_with(now["cells"], then["cells"], lambda a, b: a != b), lambda x: x))
    share = (changed.cast("float") / F.size(now["cells"])).cast("float")
    other = (now["cols"] != then["cols"]) | (now["rows"] != then["rows"])
    return F.when(other, F.lit(1.0)).when(F.size(now["cells"]) == 0, F.lit(0.0)).otherwise(share).cast("float")


def changed_cells(now: DataFrame, then: DataFrame, sizes: DataFrame, value: str = "hash", keys: list[str] = KEYS, cell: int = CELL) -> DataFrame:
    """Boxes of the cells that differ, cut to the frame; one whole box where the grids' sizes differ.

    now, then: cells by ``keys``, of the frame and of the one it is compared with.
    sizes: width and height of the frames, in both.
    """
    dims = lambda d: d.groupBy(*keys).agg((F.max("cx") + 1).alias("cols"), (F.max("cy") + 1).alias("rows"))
    a, b = dims(now), dims(then)
    frames = a.alias("a").join(b.alias("b"), keys).select(*keys, ((F.col("a.cols") != F.col("b.cols")) | (F.col("a.rows") != F.col("b.rows"))).alias("other")).join(sizes, keys)
    whole = frames.where("other").select(*keys, *[F.lit(0).cast("long").alias(c) for c in "xy"], F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"))
    both = now.alias("n").join(then.alias("t"), [*keys, "cy", "cx"]).where(F.col(f"n.{value}") != F.col(f"t.{value}")).select(*keys, "cy", "cx")
    cut = lambda at, most: F.least(F.lit(cell), F.greatest(F.col(most) - F.col(at) * cell, F.lit(0))).cast("long")
    parts = both.join(frames.where("not other"), keys).select(*keys, (F.col("cx") * cell).cast("long").alias("x"), (F.col("cy") * cell).cast("long").alias("y"), cut("cx", "width").alias("w"), cut("cy", "height").alias("h"))
    return whole.unionByName(parts)


def step(state: tuple, frame_idx: int, cells: list, size: tuple, every: int, threshold: float, most_skips: int, failed: bool = False) -> tuple:
    """One frame at the gate: (state, (sampled, changed, should_ocr, skips)).

    state: (cells and size of the last recognised frame, skips in a row). A frame is
    compared with the last recognised one, not with the one before. After a failed
    recognition the skips start anew but the cells stay.
    """
    then, then_size, skips = state
    if frame_idx % every:
        return state, (False, None, False, skips)
    changed = None
    if then is None or skips >= most_skips:
        go = True
    else:
        if then_size != size:
            changed = 1.0
        else:
            changed = float(np.float32(sum(a != b for a, b in zip(cells, then, strict=True))) / np.float32(len(cells))) if cells else 0.0
        go = changed >= np.float32(threshold)
    if not go:
        return (then, then_size, skips + 1), (True, changed, False, skips + 1)
    return ((then, then_size, 0) if failed else (cells or None, size, 0)), (True, changed, True, 0)


def gate(frames: DataFrame, every: int = 3, threshold: float = 0.0, most_skips: int = MOST_SKIPS) -> DataFrame:
    """Frames (stream_id, frame_idx, cols, rows, cells, and failed if there is one) -> the gate's log.

    Rows of a stream pass one after the other through a small state, so memory doesn't grow
    with a stream's length; streams are independent. ``every`` below 1 raises ValueError.
    """
    if every < 1:
        raise ValueError("every must be at least 1")
    ready(frames.sparkSession)
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in frames.columns else F.lit(False)
    d = frames.select("stream_id", "frame_idx", "cols", "rows", F.col("cells").cast("array<string>").alias("cells"), failed.alias("failed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, (None, None, 0)
        for b in batches:
            stream, frame, cols, rows, cells, bad = (b.column(i).to_pylist() for i in range(6))
            out = []
            for s, f, c, r, h, x in zip(stream, frame, cols, rows, cells, bad, strict=True):
                if s != now:
                    now, state = s, (None, None, 0)
                state, log = step(state, f, h, (c, r), every, threshold, most_skips, x)
                out.append((s, f, *log))
            yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.float32(), pa.bool_(), pa.int32()))], ["stream_id", "frame_idx", "sampled", "changed", "should_ocr", "consecutive_skips"])

    from ..schemas import GATE_LOG

    return d.repartition("stream_id").sortWithinPartitions("stream_id", "frame_idx").mapInArrow(run, GATE_LOG)
