"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a key's hash. A bucket that holds more
bytes than a shard may hold splits on one more bit, the others stay; so every shard is a
hash prefix of its own depth.

The directory comes from a histogram: bytes by the first ``step`` bits, summed upward to
every shorter prefix. What is still too large at that depth goes on with the next bits,
and only its rows do. Rows beyond the hash's last bit share a hash; they are cut into
overflow shards by a running sum over salted ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, prepare

LIMIT = 4_000_000
#: Bits of the hash that a directory may use.
BITS = 60


def hash_bits(*keys: Column) -> Column:
    """60 bits of the keys' md5, as a string of 0 and 1."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.lpad(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 2), BITS, "0")


def _resolve(rows: DataFrame, base: int, step: int, limit: int) -> DataFrame:
    """rows (bits, bytes) -> (prefix, depth, total): for each prefix of base + step bits the least depth at which its bucket fits, and that bucket's bytes; or nulls."""
    deep = base + step
    counted = rows.groupBy(F.substring("bits", 1, deep).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
    levels = counted.select("prefix", "bytes", F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("depth")).withColumn("head", F.expr("substring(prefix, 1, depth)"))
    fits = levels.groupBy("depth", "head").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit)
    found = levels.join(fits, ["depth", "head"]).groupBy("prefix").agg(F.min(F.struct("depth", "total")).alias("at"))
    return counted.select("prefix").join(found, "prefix", "left").select("prefix", "at.depth", "at.total")


def shard(docs: DataFrame, size: Column, keys: tuple[str, ...] = ("doc_id",), limit: int = LIMIT, step: int = 8, bits: Column | None = None) -> DataFrame:
    """The rows of ``docs`` with shard, depth, bytes and shard_bytes.

    shard is the hash prefix, with ``-n`` for overflow shard n; depth its bits; the empty
    prefix is the whole table. No shard is over ``limit`` bytes, but for a single row that
    is larger, alone in its shard. Rows of one hash, such as repeated rows, are cut in the
    order of a salt. Null keys hash as a value of their own; null sizes count 0. Rows
    without bytes go with their hash. A column of ``docs`` of one of the four names gives way;
    all others stay, whatever their names. No rows give no rows.

    The directory is resolved on hashes and sizes alone; rows meet it at the end, a join with
    a small table for each round. Only rows of one hash that are too many are stored.
    """
    spark = docs.sparkSession
    prepare(spark)
    mark = "shard"
    while any(c.lower().startswith(f"__{mark}") for c in docs.columns):
        mark += "_"
    own = lambda name: f"__{mark}_{name}"
    rows = docs.withColumns({own("bytes"): F.coalesce(size.cast("long"), F.lit(0)), own("bits"): bits if bits is not None else hash_bits(*[F.col(k) for k in keys])})
    left = rows.select(F.col(own("bits")).alias("bits"), F.col(own("bytes")).alias("bytes")).checkpoint()
    total = left.agg(F.sum("bytes")).first()[0] or 0
    base, first, out, depths, totals, full = 0, min(BITS, max(step, math.ceil(math.log2(max(1.0, total / limit))) + 4)), rows, [], [], None
    while True:
        deep = base + first
        found = _resolve(left, base, first, limit).checkpoint()
        depths.append(own(f"depth{deep}"))
        totals.append(own(f"total{deep}"))
        names = found.where("depth is not null").select(F.col("prefix").alias(own(f"prefix{deep}")), F.col("depth").alias(depths[-1]), F.col("total").alias(totals[-1]))
        out = out.join(names, F.substring(own("bits"), 1, deep) == F.col(own(f"prefix{deep}")), "left").drop(own(f"prefix{deep}"))
        open_ = found.where("depth is null").select("prefix")
        if not open_.take(1):
            break
        left = left.join(open_, F.substring("bits", 1, deep) == F.col("prefix"), "left_semi").checkpoint()
        base, first = deep, min(step, BITS - deep)
        if first <= 0:
            full = open_
            break
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "depth", "bytes", "shard_bytes")]
    out = out.where(F.coalesce(*depths).isNotNull())
    out = out.withColumns({own("depth"): F.coalesce(*depths), own("total"): F.coalesce(*totals)})
    last = lambda shard, depth, total: [shard.alias("shard"), depth.alias("depth"), F.col(own("bytes")).alias("bytes"), total.alias("shard_bytes")]
    done = out.select(*keep, *last(F.expr(f"substring({own('bits')}, 1, {own('depth')})"), F.col(own("depth")), F.col(own("total"))))
    if full is None:
        return done
    many = rows.join(full.select(F.col("prefix").alias(own("bits"))), own("bits"), "left_semi")
    row = F.struct(*rows.columns).alias("row")
    over = _overflow(many.select(row, F.col(own("bits")).alias("bits"), F.col(own("bytes")).alias("bytes")), limit).withColumn("shard", F.concat("bits", F.lit("-"), F.col("overflow"))).checkpoint()
    over = over.join(over.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes")), "shard").select("row.*", F.col("shard").alias(own("name")), F.col("shard_bytes").alias(own("sum")))
    return done.union(over.select(*keep, *last(F.col(own("name")), F.lit(BITS), F.col(own("sum")))))


def _overflow(left: DataFrame, limit: int) -> DataFrame:
    """Shards of rows that share a hash: salted ranges, each filled to half the limit before the next shard.

    A running sum cut at every half limit gives shards of less than the limit when no row is
    over half of it; larger rows get a shard each.
    """
    salts = 4 * partitions(left.sparkSession)
    half = max(1, limit // 2)
    left = left.withColumn("id_", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("id_"), F.lit(salts))).checkpoint()
    big = left.where(F.col("bytes") > half)
    small = left.where(F.col("bytes") <= half)
    sums = small.groupBy("bits", "salt").agg(F.sum("bytes").alias("words"))
    before = W.partitionBy("bits").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("bits", "salt", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    run = W.partitionBy("bits", "salt").orderBy("id_").rowsBetween(W.unboundedPreceding, -1)
    small = small.join(sums, ["bits", "salt"]).withColumn("overflow", F.floor((F.col("before") + F.coalesce(F.sum("bytes").over(run), F.lit(0))) / half) * 2)
    return small.drop("id_", "salt", "before").unionByName(big.withColumn("overflow", F.col("id_") * 2 + 1).drop("id_", "salt"))
