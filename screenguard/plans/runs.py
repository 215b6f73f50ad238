"""The runs, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.detect import scan
from ..functions.geometry import blur_region, preview_size
from ..functions.qr import corners_box, payload_kind, payload_sensitive
from ..operators import framediff, rows, series, sticky
from ..operators.pixels import blur_frames

KEYS = ["stream_id", "frame_idx"]


def text_hits(texts: DataFrame, words: tuple[str, ...], text: str = "text") -> DataFrame:
    """Lines of texts -> a row for each line and kind that fires."""
    lines = texts.withColumn("line", F.explode(F.split(F.col(text), "\n")))
    # outer: else the optimizer scans each line once more, to see whether its kinds are none
    return lines.withColumn("kind", F.explode_outer(scan(F.col("line"), words))).where("kind is not null")


def qr_hits(codes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Codes (corners, payload, width, height) -> hits of the sensitive ones, under the seed phrase's kind."""
    keys = keys or KEYS
    box = corners_box(F.col("corners"), F.col("width"), F.col("height"))
    return codes.where(payload_sensitive(payload_kind(F.col("payload")))).select(*keys, F.lit("SeedPhrase").alias("kind"), box.alias("b")).select(*keys, "kind", "b.*")


def single_shot(lines: DataFrame, codes: DataFrame, words: tuple[str, ...], keys: list[str] | None = None) -> DataFrame:
    """Lines and codes -> all hits."""
    keys = keys or KEYS
    found = rows.detect(lines, words, keys).select(*keys, "kind", "x", "y", "w", "h")
    return found.unionByName(qr_hits(codes, keys))


def record(frames: DataFrame, cells: DataFrame, lines: DataFrame, codes: DataFrame, words: tuple[str, ...], every: int = 3, threshold: float = 0.0) -> dict[str, DataFrame]:
    """A recorded session: the gate's log, the hits of the frames it lets through, and the regions alive at each frame.

    frames (stream_id, frame_idx, width, height), cells by frame, and lines and codes by frame.
    """
    log = framediff.gate(framediff.grid(cells), every, threshold)
    through = log.where("should_ocr").select(*KEYS)
    hits = single_shot(lines.join(through, KEYS, "left_semi"), codes.join(through, KEYS, "left_semi"), words)
    alive = sticky.on_frames(frames, hits)
    region = blur_region(*[F.col(c) for c in "xywh"], F.col("width"), F.col("height"))
    regions = alive.join(frames.select(*KEYS, "width", "height"), KEYS).select(*KEYS, region.alias("r")).select(*KEYS, "r.*")
    return {"log": log, "hits": hits, "regions": regions}


def blur(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """The frames with their regions blurred."""
    return blur_frames(frames, regions)


def preview(frames: DataFrame, most: int = 1280) -> DataFrame:
    """Frames with the size of their preview."""
    return frames.withColumn("s", preview_size(F.col("width"), F.col("height"), most)).select(*frames.columns, F.col("s.w").alias("preview_w"), F.col("s.h").alias("preview_h"))


def collect(keys: DataFrame, label: str) -> DataFrame:
    """Frames (stream_id, frame_idx, captured_at, down) at which the key goes down, with the name of the file to save."""
    order = W.partitionBy("stream_id").orderBy("frame_idx")
    edges = keys.withColumn("edge", series.pressed(F.col("down"), order)).where("edge")
    return edges.select(*KEYS, series.saved_name(F.lit(label), F.col("captured_at")).alias("name"))


def summary(log: DataFrame, hits: DataFrame) -> DataFrame:
    """Frames, recognised, skipped and hits of each stream of a recorded session."""
    counts = hits.groupBy(*KEYS).agg(F.count("*").alias("hits"))
    return series.run_summary(log.join(counts, KEYS, "left").fillna(0, ["hits"]))
