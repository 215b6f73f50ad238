"""Object detections: the model's anchors to boxes, and suppression of overlapping ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import f32, iou, letterbox
from ..patterns import CLASSES

# Fixed values.
CONFIDENCE, OVERLAP, INPUT = 0.35, 0.5, 640
BOX = ["x", "y", "w", "h"]


def best_class(scores: Column) -> Column:
    """(class, confidence): the first greatest score above 0; class 0 with 0 if there is none."""
    top = F.greatest(F.array_max(scores), f32(0.0))
    return F.struct(F.when(top > 0, F.array_position(scores, top) - 1).otherwise(F.lit(0)).cast("int").alias("class"), top.alias("confidence"))


def class_name(number: Column) -> Column:
    """The class's name; null for a number without one."""
    return F.get(F.array(*[F.lit(c) for c in CLASSES]), number)


def decode(anchors: DataFrame, width: Column, height: Column, threshold: float = CONFIDENCE, target: int = INPUT) -> DataFrame:
    """Anchors in the model's square -> detections in the frame; weak, empty and unnamed ones go."""
    box = letterbox(width, height, target)
    d = anchors.withColumn("b", best_class(F.col("scores"))).withColumn("l", box).where(F.col("b.confidence") >= f32(threshold))
    half = lambda c: (f32(c) / 2).cast("float")
    back = lambda v, pad: f32(f32(f32(v) - f32(F.col(f"l.{pad}"))) / F.col("l.scale"))
    low = lambda c, size, pad: F.greatest(back(F.col(c) - half(F.col(size)), pad), f32(0.0)).cast("long")
    high = lambda c, size, pad, most: F.least(F.greatest(back(F.col(c) + half(F.col(size)), pad), f32(0.0)).cast("long"), most.cast("long"))
    d = d.select(*[c for c in anchors.columns if c not in ("cx", "cy", "w", "h", "scores")], F.col("b.class").alias("class"), F.col("b.confidence").alias("confidence"), low("cx", "w", "pad_x").alias("x"), low("cy", "h", "pad_y").alias("y"), high("cx", "w", "pad_x", width).alias("x1"), high("cy", "h", "pad_y", height).alias("y1"))
    d = d.where((F.col("x1") > F.col("x")) & (F.col("y1") > F.col("y")) & (F.col("class") < len(CLASSES)))
    return d.withColumns({"w": F.col("x1") - F.col("x"), "h": F.col("y1") - F.col("y")}).drop("x1", "y1")


def suppress(detections: DataFrame, overlap: float = OVERLAP, keys: tuple[str, ...] = ("frame_idx",), order: str = "anchor") -> DataFrame:
    """Of overlapping detections of a class the most confident; ties by ``order``.

    A detection goes if a kept one of its class overlaps it by more than ``overlap``: a fold
    over a frame's detections by falling confidence. Classes don't meet, so they are folded apart.
    """
    rest = [c for c in detections.columns if c not in (*keys, "class", "confidence", order, *BOX)]
    item = F.struct((-F.col("confidence")).alias("n"), order, "confidence", *BOX, *rest)
    each = detections.groupBy(*keys, "class").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = each.schema["all"].dataType.simpleString()
    kept = F.aggregate("all", F.array().cast(kind), lambda kept, c: F.when(F.exists(kept, lambda k: iou(k, c) > f32(overlap)), kept).otherwise(F.array_append(kept, c)))
    return each.select(*keys, "class", F.explode(kept).alias("k")).select(*keys, "class", "k.*").drop("n")
