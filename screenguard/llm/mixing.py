"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source is to give ``target`` words: target / size copies of each document on average.
The whole part is certain; the rest is drawn with unequal inclusion probabilities p, that
grow with the root of a document's size and fill the words that are left: the sum of
p * size is the target's rest. Where that asks for p over 1 the copy is certain too.
Documents are ranked by Pareto's order, random odds u / (1 - u) over inclusion odds
p / (1 - p), and the head of that order is taken until its words fill what the certain
copies leave: the sample's fixed size is in words.

The order is never sorted as a whole: documents are counted into narrow ranges of the rank,
running sums over the ranges find the one that holds the cut, and only that range's
documents are ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Ranges of the rank that a source's documents are counted into.
RANGES = 8192


def word_count(text: Column) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sized (source, size) -> (source, source_size, target).

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` of
    all sizes; none gets more than ``most`` times its own, and the excess goes to the others
    by weight: the caps that bind are those of least size to weight. If all bind, all stand.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    sums = sums.select("source", "source_size", w.alias("w"), (F.lit(most) * F.col("source_size")).alias("cap"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    all_ = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    sums = sums.withColumn("level", level)
    sums = sums.withColumn("at", F.row_number().over(order))
    free = F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct("at", "level"))  # the first that its cap doesn't bind
    sums = sums.withColumn("level", F.min(free).over(all_)["level"])
    return sums.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the md5 of the key; the same on every run."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def inclusion_scale(sizes: DataFrame) -> DataFrame:
    """sizes (source, size, n, want) -> (source, scale): p = least(1, scale * sqrt(size)) makes the sum of p * size ``want``.

    The largest sizes reach 1 first; the scale is that of the largest size that doesn't.
    """
    order = W.partitionBy("source").orderBy(F.desc("size"))
    words = F.col("n") * F.col("size")
    full = F.coalesce(F.sum(words).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(words * F.sqrt("size")).over(order.rowsBetween(0, W.unboundedFollowing))
    each = sizes.where("size > 0").withColumn("scale", (F.col("want") - full) / rest)
    return each.where("scale * sqrt(size) <= 1").groupBy("source").agg(F.max_by("scale", "size").alias("scale"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 1, ranges: int = RANGES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, p), a row for each row of ``docs``.

    copies is a whole number of at most ``most``; taken = copies * size; p is the inclusion
    probability of the copy that isn't certain, null where a source's copies are all certain.
    After the ordered head, one further document, whose words come nearest to what is still
    missing, closes the gap if that brings the sum nearer. Null texts and texts without words
    have size 0 and only their certain copies; null sources are one source. Ties of the rank
    go by id, then by size. Repeated rows are separate documents. Other columns are ignored;
    no rows give no rows.
    """
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
    d = d.withColumn("u", uniform(F.col("doc_id"), seed)).checkpoint()
    targets = source_targets(d.select("source", "size"), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("whole", F.least(F.floor(ratio), F.lit(int(most)))).withColumn("want", (ratio - F.col("whole")) * F.col("source_size"))
    plan = plan.withColumn("open", (ratio - F.col("whole")) > 1e-12).checkpoint()
    sizes = d.groupBy("source", "size").agg(F.count("*").alias("n")).alias("s").join(plan.alias("t"), F.expr("s.source <=> t.source and open")).select("s.*", "want")
    scale = inclusion_scale(sizes)
    plan = plan.alias("t").join(scale.alias("c"), F.expr("t.source <=> c.source"), "left").select("t.*", "scale").checkpoint()

    # Pareto's ratio q as q / (1 + q), between 0 and 1
    p = F.when(F.col("open"), F.least(F.lit(1.0), F.col("scale") * F.sqrt("size")))
    rank = F.when(F.col("p") > 0, F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + F.col("p") * (1 - F.col("u")))).otherwise(F.lit(1.0))
    rows = d.alias("d").join(plan.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "source_size", "target", "whole", "want", "open", "scale").withColumn("p", p).withColumn("rank", rank)
    rows = rows.withColumn("range", F.least(F.floor(F.col("rank") * ranges), F.lit(ranges - 1)).cast("int"))
    counted = rows.where("open").groupBy("source", "range").agg(F.sum("size").alias("words"), F.first("want").alias("want"))
    run = W.partitionBy("source").orderBy("range")
    sums = counted.withColumn("before", F.coalesce(F.sum("words").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cut = sums.where("before <= want and want < before + words").groupBy("source").agg(F.max("range").alias("cut"), F.max("before").alias("before"))
    rows = rows.alias("d").join(cut.alias("c"), F.expr("d.source <=> c.source"), "left").select("d.*", F.expr("coalesce(c.cut, if(open, 2147483647, -1))").alias("cut"), F.expr("coalesce(c.before, 0)").alias("before"))
    order = W.partitionBy("source").orderBy("rank", "doc_id", "size")
    edge = rows.where("open and range = cut").withColumn("sum", F.col("before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    edge = edge.withColumn("picked", (F.col("sum") <= F.col("want")) & (F.col("p") > 0))
    inner = rows.where("not (open and range = cut)").withColumn("picked", F.col("open") & (F.col("range") < F.col("cut")) & (F.col("p") > 0))
    keep = ["doc_id", "source", "size", "source_size", "target", "whole", "want", "open", "u", "p", "picked"]
    chosen = edge.select(*keep).union(inner.select(*keep)).checkpoint()

    gap = chosen.where("open").groupBy("source").agg((F.first("want") - F.sum(F.when(F.col("picked"), F.col("size")).otherwise(0))).alias("gap"))
    rest = chosen.where("open and not picked and size > 0").alias("r").join(gap.alias("g"), F.expr("r.source <=> g.source"))
    close = rest.groupBy("r.source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "u", "doc_id", "size")).alias("b"), F.first("gap").alias("gap"))
    close = close.where("b.off < gap").select(F.col("source").alias("s"), "b.u", "b.doc_id", "b.size")
    # of repeated rows one closes the gap
    more = chosen.alias("a").join(close.alias("b"), F.expr("a.source <=> b.s and a.u = b.u and a.doc_id <=> b.doc_id and a.size = b.size and open and not picked"), "left")
    first = F.row_number().over(W.partitionBy("a.source", "a.u", "a.doc_id", "a.size").orderBy(F.lit(1))) == 1
    last = more.where("b.u is not null").withColumn("first", first)
    rest = more.where("b.u is null").withColumn("first", F.lit(False))
    out = last.union(rest)
    copies = F.col("whole") + (F.col("picked") | F.col("first")).cast("long")
    return out.select("a.doc_id", "a.source", "a.size", "source_size", "target", copies.alias("copies"), (copies * F.col("a.size")).alias("taken"), "p")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    key = ["doc_id", "source", "size"]
    taken = mix(docs, id_col, text_col, source_col, **how).groupBy(*key).agg(F.sum("copies").alias("c"), F.count("*").alias("n")).alias("t")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size")).alias("d")
    same = rows.join(taken, F.expr(" and ".join(f"d.{k} <=> t.{k}" for k in key))).where("c > 0")
    # rows that can't be told apart share their copies
    place = F.row_number().over(W.partitionBy(*[f"d.{k}" for k in key]).orderBy(F.lit(1)))
    each = F.floor(F.col("c") / F.col("n")) + (place <= F.col("c") % F.col("n")).cast("long")
    return same.select("row", each.alias("each")).where("each > 0").select("row", F.explode(F.expr("sequence(1L, each)"))).select("row.*")
