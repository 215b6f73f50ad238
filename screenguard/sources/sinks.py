"""Sinks: overlays, frames, labels."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import frame_name, kind_label
from ..operators.dataset import label_line


def png(rgba: bytes, width: int, height: int) -> bytes:
    """A PNG file of 8-bit RGBA pixels."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + rgba[i : i + width * 4] for i in range(0, len(rgba), width * 4))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def overlays(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Hits -> three nested rectangles each, with the label and where it would stand."""
    keys = keys or ["frame_idx"]
    d = hits.withColumn("d", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    one = lambda c: F.greatest(F.col(c), F.lit(1)).alias(c)
    return d.select(*keys, "kind", kind_label(F.col("kind")).alias("label"), F.greatest(F.col("y") - 20, F.lit(0)).alias("label_y"), (F.col("x") + F.col("d")).alias("x"), (F.col("y") + F.col("d")).alias("y"), one("w"), one("h"))


def encoded_frames(frames: DataFrame) -> DataFrame:
    """(stream_id, name, png) of frames: the files of a recorded sequence, as rows."""
    from collections.abc import Iterator

    import pyarrow as pa

    from ..operators.pixels import image, swapped
    from ..session import ready

    ready(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [png(swapped(image(d, w, h)).tobytes(), w, h) for w, h, d in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(files, pa.binary())], ["stream_id", "name", "png"])

    return frames.select("stream_id", frame_name(F.col("frame_idx")).alias("name"), "width", "height", "bgra").mapInArrow(run, "stream_id bigint, name string, png binary")


def write_frames(frames: DataFrame, path: str):
    """A recorded sequence as a table of PNG files (stream_id, name, png) under ``path``.

    Of a stream every trigger's files go to a folder of its own, written anew if the trigger
    is run again, so that each frame is there once; gives the writer, to be started.
    """
    files = encoded_frames(frames)
    if not frames.isStreaming:
        files.write.mode("overwrite").partitionBy("stream_id").parquet(path)
        return None
    return files.writeStream.foreachBatch(lambda d, k: d.write.mode("overwrite").parquet(f"{path}/trigger={k}"))


def write_labels(labels: DataFrame, path: str) -> None:
    """(image, label) as text, a folder an image, a line a label."""
    labels.select("image", label_line(F.col("label")).alias("value")).write.mode("overwrite").partitionBy("image").text(path)
