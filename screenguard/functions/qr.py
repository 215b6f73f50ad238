"""QR codes: payload kinds, boxes, grey values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..patterns import QR_ADDRESSES, QR_PAYMENT, QR_SEED, QR_SEED_WORDS, java
from .text import trimmed


def payload_kind(payload: Column) -> Column:
    """Address, PaymentUri, SeedPhrase or Unknown; the first that fits. Null counts as undecodable: Unknown."""
    t = trimmed(payload)
    address = F.lit(False)
    for p in QR_ADDRESSES:
        address = address | t.rlike(java(p))
    seed = t.rlike(java(QR_SEED)) & F.size(F.split(t, r"(?U)\s+")).isin(*QR_SEED_WORDS)
    return F.when(address, "Address").when(t.rlike(java(QR_PAYMENT)), "PaymentUri").when(seed, "SeedPhrase").otherwise("Unknown")


def payload_sensitive(kind: Column) -> Column:
    return kind.isin("Address", "PaymentUri", "SeedPhrase")


def corners_box(corners: Column, width: Column, height: Column) -> Column:
    """Box around the corners, cut to the frame; negative corners count as 0."""
    side = lambda axis: F.transform(corners, lambda c: F.greatest(c[axis], F.lit(0)))
    x0, x1, y0, y1 = F.array_min(side("x")), F.array_max(side("x")), F.array_min(side("y")), F.array_max(side("y"))
    x, y = F.least(x0, width), F.least(y0, height)
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.least(x1 - x0, width - x).cast("long").alias("w"), F.least(y1 - y0, height - y).cast("long").alias("h"))


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Integer grey value by BT.601."""
    return F.floor((299 * red + 587 * green + 114 * blue) / 1000).cast("int")
