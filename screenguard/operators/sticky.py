"""Hits that stay alive for some frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import quantised

# Fixed value: frames that a hit stays for.
LIFETIME = 30
BOX = ["x", "y", "w", "h"]


def intervals(hits: DataFrame, lifetime: int = LIFETIME, stream: str = "stream_id") -> DataFrame:
    """Hits -> (stream, box, start, stop): where each quantised box is alive, stop not included.

    A hit lives from its frame for ``lifetime`` frames; one more of the same box in that
    time, or at its end, prolongs it and never shortens it. One shuffle by box.
    """
    q = quantised(*[F.col(c) for c in BOX])
    keyed = hits.select(stream, "frame_idx", q.alias("q")).select(stream, "frame_idx", "q.*")
    order = W.partitionBy(stream, *BOX).orderBy("frame_idx")
    fresh = F.col("frame_idx") - F.lag("frame_idx").over(order) <= lifetime
    runs = keyed.withColumn("run", F.sum(F.when(F.coalesce(fresh, F.lit(False)), 0).otherwise(1)).over(order))
    return runs.groupBy(stream, *BOX, "run").agg(F.min("frame_idx").alias("start"), (F.max("frame_idx") + lifetime).alias("stop")).drop("run")


def active(hits: DataFrame, lifetime: int = LIFETIME, stream: str = "stream_id") -> DataFrame:
    """(stream, frame_idx, box): the boxes alive at each frame, from joined intervals, so no row repeats."""
    return intervals(hits, lifetime, stream).select(stream, F.explode(F.expr("sequence(start, stop - 1)")).alias("frame_idx"), *BOX)


def on_frames(frames: DataFrame, hits: DataFrame, lifetime: int = LIFETIME, stream: str = "stream_id", span: int = 256) -> DataFrame:
    """The boxes alive at the given frames: a range join, by spans of frames that both sides fall into."""
    spans = intervals(hits, lifetime, stream).withColumn("span", F.explode(F.expr(f"sequence(start div {span}, (stop - 1) div {span})")))
    there = frames.select(stream, "frame_idx", F.floor(F.col("frame_idx") / span).alias("span"))
    return there.join(spans, [stream, "span"]).where("start <= frame_idx and frame_idx < stop").select(stream, "frame_idx", *BOX)


def expiries(hits: DataFrame, lifetime: int = LIFETIME, stream: str = "stream_id") -> DataFrame:
    """Each hit with the frame at which its box goes, as known then: the greatest so far."""
    q = quantised(*[F.col(c) for c in BOX])
    keyed = hits.select(stream, "frame_idx", q.alias("q")).select(stream, "frame_idx", "q.*")
    order = W.partitionBy(stream, *BOX).orderBy("frame_idx").rangeBetween(W.unboundedPreceding, 0)
    return keyed.withColumn("expiry", F.max(F.col("frame_idx") + lifetime).over(order))
