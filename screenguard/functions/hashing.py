"""64-bit FNV-1a in generated arithmetic: two 32-bit limbs, so that no product overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hash's offset basis, and its prime 2 ** 40 + 0x1b3.
BASIS = 0xCBF29CE484222325
PRIME_LOW = 0x1B3
_MASK = 0xFFFFFFFF


def fnv1a64(data: Column) -> Column:
    """The hash of a binary or string column's bytes, as 16 lower-case hexadecimal digits.

    For rows of short values; whole images go through ``pixels.cell_hashes``.
    """
    digits = F.hex(data.cast("binary"))
    byte = lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    state = F.struct(F.lit(BASIS >> 32).cast("long").alias("hi"), F.lit(BASIS & _MASK).cast("long").alias("lo"))

    def step(a: Column, i: Column) -> Column:
        lo = a["lo"].bitwiseXOR(byte(i))
        low = lo * PRIME_LOW
        hi = a["hi"] * PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(hi.bitwiseAND(F.lit(_MASK)).alias("hi"), low.bitwiseAND(F.lit(_MASK)).alias("lo"))

    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(places, state, step)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))
