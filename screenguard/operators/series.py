"""Sampling, delay, edges and running figures over ordered frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def every_nth(frames: DataFrame, n: int, frame: str = "frame_idx") -> DataFrame:
    """Frames whose number divides by n. Stands before anything costly, as a plain filter."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return frames.where(F.col(frame) % n == 0)


def delayed(frames: DataFrame, capacity: int, value: str, stream: str = "stream_id", frame: str = "frame_idx") -> DataFrame:
    """Each frame with the value that leaves a buffer of ``capacity`` when it comes in; null until the buffer is full."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    return frames.withColumn("tail", F.lag(value, capacity - 1).over(W.partitionBy(stream).orderBy(frame)))


def ring(frames: DataFrame, capacity: int, value: str, stream: str = "stream_id", frame: str = "frame_idx") -> DataFrame:
    """Each frame with what a ring of ``capacity`` holds once it is pushed: its number, how many there are, and the values at head and tail.

    The head is the newest, that a peek sees; the tail the oldest, that a pop takes, null until the ring is full.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    order = W.partitionBy(stream).orderBy(frame)
    number = F.row_number().over(order)
    return frames.select("*", (number - 1).cast("long").alias("number"), F.least(number, F.lit(capacity)).alias("held"), F.col(value).alias("head"), F.lag(value, capacity - 1).over(order).alias("tail"))


def newest(frames: DataFrame, value: str, stream: str = "stream_id", frame: str = "frame_idx") -> DataFrame:
    return frames.groupBy(stream).agg(F.max(frame).alias(frame), F.max_by(value, frame).alias(value))


def pressed(down: Column, order: W) -> Column:
    """Whether a key goes down here: it is, and wasn't before."""
    return down & ~F.coalesce(F.lag(down).over(order), F.lit(False))


def saved_name(label: Column, at: Column) -> Column:
    return F.concat(label, F.lit("_"), F.unix_millis(at.cast("timestamp")).cast("string"), F.lit(".png"))


def run_summary(log: DataFrame, stream: str = "stream_id") -> DataFrame:
    """A gate log with hits -> frames, recognised, skipped and hits of each stream."""
    return log.groupBy(stream).agg(
        F.count("*").alias("frames"),
        F.sum(F.col("should_ocr").cast("long")).alias("ocr_count"),
        F.sum((F.col("sampled") & ~F.col("should_ocr")).cast("long")).alias("ocr_skipped"),
        F.sum("hits").alias("total_hits"),
    )


def frame_rate(frames: DataFrame, at: str, stream: str = "stream_id") -> DataFrame:
    """Frames a second between a stream's first and last; null for one moment."""
    span = F.max(at).cast("timestamp").cast("double") - F.min(at).cast("timestamp").cast("double")
    return frames.groupBy(stream).agg(F.count("*").alias("frames"), F.when(span > 0, F.count("*") / span).alias("fps"))


def frame_period_us(fps: int) -> int:
    """Microseconds from frame to frame."""
    if fps < 1:
        raise ValueError("fps must be at least 1")
    return 1_000_000 // fps
