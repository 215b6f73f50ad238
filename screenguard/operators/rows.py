"""Recognised words to lines, lines to rows, rows to hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.detect import scan_row
from ..functions.text import hex_chunk

FRAME = ["frame_idx"]
# Totals of hexadecimal digits that look like an address or a key.
STITCHED = (39, 40, 41, 63, 64, 65)


def word_lines(words: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """OCR words -> a box a line: union of its words' boxes, corners below 0 as 0, cut to whole pixels.

    A line without words has no row.
    """
    edge = lambda v: F.greatest(v, F.lit(0.0).cast("float")).cast("long")
    x1, y1 = (F.col("x") + F.col("w")).cast("float"), (F.col("y") + F.col("h")).cast("float")
    box = words.groupBy(*keys, "line_no").agg(*[edge(e).alias(n) for n, e in (("x", F.min("x")), ("y", F.min("y")), ("x1", F.max(x1)), ("y1", F.max(y1)))])
    return box.select(*keys, "line_no", "x", "y", F.greatest(F.col("x1") - F.col("x"), F.lit(0)).alias("w"), F.greatest(F.col("y1") - F.col("y"), F.lit(0)).alias("h"))


def assign_rows(lines: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Lines with row_id: each joins the first row whose mean centre is near enough, in line order, else opens one.

    Near: 0.6 of the larger of its height and the row's greatest, 6 pixels at least, in
    single precision. The mean moves as lines join, so this is a fold over a frame's lines,
    not a window; a frame's lines always fit one task.
    """
    fields = [c for c in lines.columns if c not in keys]
    sorted_lines = F.array_sort(F.collect_list(F.struct("line_no", *[c for c in fields if c != "line_no"]))).alias("lines")
    frames = lines.groupBy(*keys).agg(sorted_lines)
    fold = F.expr("""
        aggregate(lines,
          named_struct('rows', cast(array() as array<struct<total: float, n: int, h: bigint>>), 'ids', cast(array() as array<int>)),
          (a, l) -> transform(array(named_struct(
              'at', array_position(transform(a.rows, r -> abs(cast(cast(l.y as float) + cast(l.h as float) / 2 as float) - cast(r.total / r.n as float))
                      <= greatest(cast(greatest(l.h, r.h) as float) * cast(0.6 as float), cast(6 as float))), true),
              'cy', cast(cast(l.y as float) + cast(l.h as float) / 2 as float))),
            p -> named_struct(
              'rows', if(p.at = 0, array_append(a.rows, named_struct('total', p.cy, 'n', 1, 'h', l.h)),
                transform(a.rows, (r, i) -> if(i = p.at - 1, named_struct('total', r.total + p.cy, 'n', r.n + 1, 'h', greatest(r.h, l.h)), r))),
              'ids', array_append(a.ids, cast(if(p.at = 0, size(a.rows), p.at - 1) as int))))[0],
          a -> a.ids)
    """)
    pairs = frames.select(*keys, F.explode(F.arrays_zip("lines", fold.alias("ids"))).alias("z"))
    return pairs.select(*keys, F.col("z.ids").cast("long").alias("row_id"), "z.lines.*")


def row_stats(assigned: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Lines with row_id -> a row each: parts by x (ties by line) joined by a space, union box, mean centre, greatest height."""
    part = F.array_sort(F.collect_list(F.struct("x", "line_no", "text")))
    cy = (F.col("y").cast("float") + F.col("h").cast("float") / 2).cast("float")
    out = assigned.groupBy(*keys, "row_id").agg(
        F.array_join(F.transform(part, lambda p: p["text"]), " ").alias("text"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("x1"),
        F.max(F.col("y") + F.col("h")).alias("y1"),
        F.avg(cy).cast("float").alias("cy_avg"),
        F.max("h").alias("max_h"),
    )
    return out.select(*keys, "row_id", "text", "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"), "cy_avg", "max_h")


def merged_rows(lines: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    return row_stats(assign_rows(lines, keys), keys).drop("cy_avg", "max_h")


def row_kinds(rows: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Rows with their kinds, empty where nothing fires: the log of verdicts."""
    return rows.withColumn("kinds", scan_row(F.col("text"), words))


def row_hits(rows: DataFrame, words: tuple[str, ...], keys: list[str] = FRAME) -> DataFrame:
    """A hit for each row and kind, with the row's box."""
    return row_kinds(rows, words).select(*keys, "row_id", F.explode("kinds").alias("kind"), "x", "y", "w", "h")


def hex_stitch(rows: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Hits of rows that hold parts of one wrapped hexadecimal value.

    Islands of rows from top to bottom (ties by row): only hexadecimal ones, each gap from
    minus the lower row's height to the larger height. An island of two or more rows whose
    digits add up to a known length gives a hit for every row. Only neighbours decide where
    an island ends, so a window does it.
    """
    order = W.partitionBy(*keys).orderBy("y", "row_id")
    d = rows.withColumn("hex", hex_chunk(F.col("text"))).withColumn("prev", F.lag(F.struct("y", "h", "hex")).over(order))
    gap = F.col("y") - (F.col("prev.y") + F.col("prev.h"))
    joined = F.col("hex").isNotNull() & F.col("prev.hex").isNotNull() & (gap <= F.greatest("prev.h", "h")) & (gap >= -F.col("h"))
    d = d.withColumn("island", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(order)).where("hex is not null")
    whole = W.partitionBy(*keys, "island")
    d = d.withColumn("total", F.sum(F.length("hex")).over(whole)).withColumn("n", F.count("*").over(whole))
    return d.where((F.col("n") >= 2) & F.col("total").isin(*STITCHED)).select(*keys, "row_id", F.lit("HexPrivateKey").alias("kind"), "x", "y", "w", "h")


def detect(lines: DataFrame, words: tuple[str, ...], keys: list[str] = FRAME) -> DataFrame:
    """Lines -> hits: the rows' own, then those of stitched rows; a row can have both."""
    rows = merged_rows(lines, keys)
    return row_hits(rows, words, keys).unionByName(hex_stitch(rows, keys))


def kind_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("kind").agg(F.count("*").alias("n"))
