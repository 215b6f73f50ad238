"""Sources: tables of frames, words, lines and windows; image folders; engines as plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import ready

TABLES = {"frames": schemas.FRAMES, "ocr_words": schemas.OCR_WORDS, "ocr_lines": schemas.OCR_LINES, "windows": schemas.WINDOWS, "hits": schemas.HITS, "cell_hashes": schemas.CELL_HASHES, "anchors": schemas.ANCHORS}
FORMATS = ("parquet", "orc", "json", "csv")


class UnknownSource(ValueError):
    """No source has that name."""


class NoDisplay(RuntimeError):
    """No display is marked as the primary one."""


class ModelNotFound(FileNotFoundError):
    """There is no model file at the path."""


def read(spark: SparkSession, name: str, path: str, kind: str = "parquet", stream: bool = False, **options) -> DataFrame:
    """A table by its name and declared schema, from files; as a stream of new files if asked."""
    if name not in TABLES:
        raise UnknownSource(f"{name}: one of {', '.join(sorted(TABLES))}")
    if kind not in FORMATS:
        raise UnknownSource(f"{kind}: one of {', '.join(FORMATS)}")
    reader = spark.readStream if stream else spark.read
    return reader.schema(TABLES[name]).format(kind).options(**options).load(path)


def images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(stem, path, content) of the images of a folder, by path."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return d.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), "path", "content").orderBy("path")


def primary_display(displays: DataFrame) -> DataFrame:
    """The first display marked as primary, by number; raises NoDisplay without one."""
    found = displays.where("is_primary").orderBy("display").limit(1)
    if found.isEmpty():
        raise NoDisplay("no primary display")
    return found


def window_rects(windows: DataFrame) -> DataFrame:
    """Windows with w and h from their edges; an unreadable process is an empty name."""
    return windows.select("frame_idx", "title", F.coalesce("process_name", F.lit("")).alias("process_name"), F.col("left").alias("x"), F.col("top").alias("y"), (F.col("right") - F.col("left")).alias("w"), (F.col("bottom") - F.col("top")).alias("h"))


def language(user: list[str], default: str = "en-US") -> str:
    """The recogniser's language: the user's first, else the default."""
    return next((x for x in user if x), default)


def recognise(frames: DataFrame, engine: Callable[[bytes, int, int], list[tuple[str, float, float, float, float, int]]]) -> DataFrame:
    """Words of frames by an engine: a function of (bgra, width, height) that gives (text, x, y, w, h, line).

    The engine is sent to the workers; frames it fails on raise. Put filters such as
    ``every_nth`` before it: nothing moves them below a Python function.
    """
    ready(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, f, w, h, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                found = engine(data, w, h)
                cols = [[s] * len(found), [f] * len(found), [x[5] for x in found], list(range(len(found))), [x[0] for x in found], *[[x[i] for x in found] for i in range(1, 5)]]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.float32()] * 4)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["stream_id", "frame_idx", "line_no", "word_no", "text", "x", "y", "w", "h"])

    return frames.select("stream_id", "frame_idx", "width", "height", "bgra").mapInArrow(run, "stream_id bigint, frame_idx bigint, line_no int, word_no int, text string, x float, y float, w float, h float")


def scan_codes(frames: DataFrame, decoder: Callable[[bytes, int, int], list[tuple[list[tuple[int, int]], str | None]]]) -> DataFrame:
    """QR codes of frames by a decoder of grey images: (corners, payload, or None if undecodable). Short buffers have none."""
    from ..operators.pixels import luma

    ready(frames.sparkSession)
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corner = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
        for b in batches:
            for s, f, w, h, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if not data or len(data) < w * h * 4 or not w * h:
                    continue
                grey = luma(np.frombuffer(data[: w * h * 4], np.uint8).reshape(h, w, 4))
                found = decoder(grey.tobytes(), w, h)
                n = len(found)
                yield pa.record_batch([pa.array([s] * n, pa.int64()), pa.array([f] * n, pa.int64()), pa.array([w] * n, pa.int32()), pa.array([h] * n, pa.int32()), pa.array([[{"x": x, "y": y} for x, y in c] for c, _ in found], corner), pa.array([p for _, p in found], pa.string())], ["stream_id", "frame_idx", "width", "height", "corners", "payload"])

    return frames.select("stream_id", "frame_idx", "width", "height", "bgra").mapInArrow(run, "stream_id bigint, frame_idx bigint, width int, height int, corners array<struct<x: int, y: int>>, payload string")


def anchors(frames: DataFrame, model: str, size: int = 640) -> DataFrame:
    """Anchors of frames by an ONNX model, loaded once a worker; ModelNotFound if the file isn't there.

    The model takes float [1, 3, size, size] and gives [1, 4 + classes, anchors].
    """
    import os

    if not os.path.exists(model):
        raise ModelNotFound(model)
    ready(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import onnxruntime

        from ..operators.pixels import image, letterboxed

        session = onnxruntime.InferenceSession(model)
        name = session.get_inputs()[0].name
        for b in batches:
            for s, f, w, h, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                out = session.run(None, {name: letterboxed(image(data, w, h, longer=True), size)[None]})[0]
                if out.ndim != 3:
                    raise ValueError(f"unexpected output shape {out.shape}")
                n = out.shape[2]
                yield pa.record_batch([pa.array([s] * n, pa.int64()), pa.array([f] * n, pa.int64()), pa.array(range(n), pa.int64()), *[pa.array(out[0, i], pa.float32()) for i in range(4)], pa.array(list(out[0, 4:].T), pa.list_(pa.float32()))], ["stream_id", "frame_idx", "anchor", "cx", "cy", "w", "h", "scores"])

    return frames.select("stream_id", "frame_idx", "width", "height", "bgra").mapInArrow(run, "stream_id bigint, frame_idx bigint, anchor bigint, cx float, cy float, w float, h float, scores array<float>")
