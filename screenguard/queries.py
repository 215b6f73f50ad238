"""One query for each operator, over the driver's tables or fixtures made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import patterns, words
from .fixtures import table as fixture
from .functions import detect, geometry, hashing, qr, register, text, windows
from .operators import dataset, framediff, pixels, rows, series, sticky, vision
from .plans import runs
from .session import ready
from .sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WIDTH, HEIGHT = 1920, 1080
THRESHOLD = 0.25


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- sources and sinks ----------------------------------------------------------------


@query
def src02_primary_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    displays = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("display"), (F.col("n_regionkey") == 3).alias("is_primary"))
    return readers.primary_display(displays)


@query
def src05_word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.word_lines(fixture(spark, sf_dir, "ocr_words"))


@query
def src07_window_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.window_rects(fixture(spark, sf_dir, "windows"))


@query
def src08_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "part").select(F.explode(F.split(F.concat(F.lit(" "), "p_type", F.lit("\t|  |"), "p_brand"), r"\|")).alias("value"))
    return words.clean_words(lines)


@query
def src11_store_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = lambda prefix: F.struct(F.concat(F.lit(prefix), F.col("n_name")).alias("bundleId"), F.col("n_name").alias("trackName"), F.array(F.concat(F.lit("u1-"), "n_name"), F.lit("u2")).alias("screenshotUrls"), F.array(F.lit("pad")).alias("ipadScreenshotUrls"))
    body = F.to_json(F.struct(F.array(app("org.other."), app("com.wallet.")).alias("results")))
    prefix = F.when(F.col("n_nationkey") % 2 == 0, "com.wallet").otherwise("net.none")
    return dataset.store_screenshots(read(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), prefix.alias("prefix"), body.alias("body")))


@query
def snk01_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rows.hex_stitch(fixture(spark, sf_dir, "hex_rows"))
    return sinks.overlays(hits)


@query
def snk04_saved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", series.saved_name(F.col("event_type"), F.col("ts")).alias("name"))


@query
def snk05_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "part").select("p_partkey", dataset.editor_label(F.lit(50) + F.col("p_size") * 22).alias("l"))
    return d.select("p_partkey", dataset.label_line(F.col("l")).alias("line"))


@query
def snk06_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = framediff.gate(framediff.grid(fixture(spark, sf_dir, "cells")), 1, THRESHOLD)
    hits = fixture(spark, sf_dir, "sticky_hits").groupBy("stream_id", "frame_idx").agg(F.count("*").alias("hits"))
    return series.run_summary(log.join(hits, ["stream_id", "frame_idx"], "left").fillna(0, ["hits"]))


@query
def f01_english_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a part's words are in the list."""
    in_list = F.filter(F.split(F.lower("p_name"), " "), lambda w: text.is_word(w, words.words(spark)))
    return read(spark, sf_dir, "part").select("p_partkey", F.size(in_list).alias("n"))


@query
def f01_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list's size, its words' lengths, and how many first fours of letters they have."""
    ready(spark)
    d = spark.createDataFrame([(w,) for w in words.words(spark)], "word string")
    return d.agg(F.countDistinct("word").alias("n_words"), F.countDistinct(F.substring("word", 1, 4)).alias("n_heads"), F.min(F.length("word")).alias("shortest"), F.max(F.length("word")).alias("longest"), F.min("word").alias("first"), F.max("word").alias("last"))


@query
def sql_fnv1a64(spark: SparkSession, sf_dir: str) -> DataFrame:
    register.register(spark)
    return read(spark, sf_dir, "part").select("p_partkey", F.expr("fnv1a64(p_name)").alias("hash"))


# ---- detectors ------------------------------------------------------------------------


@query
def d01_seed_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "planted_text")
    return d.where(detect.seed_phrase(F.col("text"), words.words(spark))).select("event_id")


def _detector(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fixture(spark, sf_dir, "planted_text").where(detect.matches(F.col("text"), kind)).select("event_id")

    return run


DETECTOR_QUERIES = {kind: f"d{i:02d}_{text_.lower()}" for i, (kind, text_) in enumerate(((k, "".join(f"_{c.lower()}" if c.isupper() and j else c for j, c in enumerate(k))) for k in patterns.DETECTORS), 2)}
for _kind, _name in DETECTOR_QUERIES.items():
    QUERIES[_name] = _detector(_kind)


@query
def a03_triple_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows.row_kinds(fixture(spark, sf_dir, "planted_text"), words.words(spark))
    return d.select("event_id", F.array_join(F.array_sort("kinds"), ",").alias("kinds"))


@query
def a04_seed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "planted_text").withColumn("r", detect.seed_range(F.col("text"), words.words(spark)))
    return d.where("r is not null").select("event_id", "r.start", "r.stop")


@query
def a07_document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents by the kinds of secrets found in them."""
    return rows.kind_counts(runs.text_hits(read(spark, sf_dir, "documents").select("text"), words.words(spark)))


@query
def sql_scan_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan as a SQL function."""
    register.register(spark)
    return spark.sql("select event_id, array_join(array_sort(scan_secrets(text)), ',') as kinds from {t}", t=fixture(spark, sf_dir, "planted_text"))


# ---- text functions -------------------------------------------------------------------


@query
def f02_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "planted_text").select("event_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query
def f03_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "planted_text").select("event_id", text.normalised(F.col("text")).alias("text"))


@query
def f04_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "planted_text").select("event_id", text.collapsed(F.col("text")).alias("text"))


@query
def f05_hex_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "hex_rows").select("frame_idx", "row_id", text.hex_chunk(F.col("text")).alias("hex"))


@query
def f06_kind_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows.row_kinds(fixture(spark, sf_dir, "planted_text"), words.words(spark)).select(F.explode("kinds").alias("kind"))
    return d.groupBy("kind", text.kind_label(F.col("kind")).alias("label")).agg(F.count("*").alias("n"))


@query
def f07_fnv1a64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", hashing.fnv1a64(F.col("props")).alias("hash"))


@query
def f09_frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", text.frame_name(F.col("event_id")).alias("name"))


@query
def f11_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.search_term(F.concat("p_name", F.lit(" & "), "p_type")).alias("term"))


@query
def f12_env_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = dataset.env_line(F.sha2(F.col("event_id").cast("string"), 256), F.col("event_id"))
    return read(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query
def f13_seed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = dataset.seed_words(F.sha2(F.col("event_id").cast("string"), 256), words.SAMPLE[:50])
    return read(spark, sf_dir, "events").select("event_id", F.array_join(drawn, " ").alias("phrase"))


@query
def f14_terminal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "planted_text").where(F.contains("text", F.lit("=")))
    return d.select("event_id", text.terminal_line(F.col("text")).alias("line"))


# ---- QR codes and windows -------------------------------------------------------------


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    x, y, s = F.col("cx"), F.col("cy"), F.col("side")
    corners = F.array(point(x, y), point(x + s, y + 2), point(x + s, y + s), point(x - 3, y + s))
    return fixture(spark, sf_dir, "qr_payloads").select("qr_id", "payload", corners.alias("corners"), F.lit(320).alias("width"), F.lit(240).alias("height"))


@query
def q02_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7 % 256).alias("r"), (F.col("event_id") * 13 % 256).alias("g"), (F.col("event_id") * 31 % 256).alias("b"))
    return p.select("event_id", qr.luma(F.col("r"), F.col("g"), F.col("b")).alias("y"))


@query
def q03_corner_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = qr.corners_box(F.col("corners"), F.col("width"), F.col("height"))
    return _codes(spark, sf_dir).select("qr_id", box.alias("b")).select("qr_id", "b.*")


@query
def q04_payload_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = qr.payload_kind(F.col("payload"))
    return fixture(spark, sf_dir, "qr_payloads").select("qr_id", kind.alias("kind"), qr.payload_sensitive(kind).alias("sensitive"))


@query
def q06_qr_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.qr_hits(_codes(spark, sf_dir), ["qr_id"])


@query
def p09_window_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = windows.window_verdict(F.col("title"), F.col("process_name"))
    return fixture(spark, sf_dir, "windows").select("frame_idx", verdict.alias("verdict"), windows.verdict_sensitive(verdict).alias("sensitive"))


# ---- rows -----------------------------------------------------------------------------


@query
def a01_merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.merged_rows(fixture(spark, sf_dir, "ocr_lines"))


@query
def a02_row_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fixture(spark, sf_dir, "ocr_lines").withColumn("row_id", F.floor(F.col("line_no") / 2))
    return rows.row_stats(lines)


@query
def a05_hex_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.hex_stitch(fixture(spark, sf_dir, "hex_rows"))


@query
def a06_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row hits and stitched hits together."""
    r = fixture(spark, sf_dir, "hex_rows")
    return rows.row_hits(r, words.words(spark)).unionByName(rows.hex_stitch(r))


@query
def e01_single_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to rows to hits, with the codes' hits, a whole run."""
    codes = _codes(spark, sf_dir).withColumn("frame_idx", F.floor(F.col("qr_id") / 12))
    return runs.single_shot(fixture(spark, sf_dir, "ocr_lines"), codes, words.words(spark), ["frame_idx"])


# ---- frames ---------------------------------------------------------------------------


def _before(cells: DataFrame) -> DataFrame:
    return cells.withColumn("frame_idx", F.col("frame_idx") + 1)


@query
def a10_fraction_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = framediff.grid(fixture(spark, sf_dir, "cells"))
    order = W.partitionBy("stream_id").orderBy("frame_idx")
    pairs = g.withColumn("now", F.struct("cols", "rows", "cells")).withColumn("then", F.lag("now").over(order)).where("then is not null")
    return pairs.select("stream_id", "frame_idx", framediff.fraction_changed(F.col("now"), F.col("then")).alias("changed"))


@query
def a11_changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixture(spark, sf_dir, "cells")
    sizes = cells.select("stream_id", "frame_idx").distinct().withColumns({"width": F.lit(250), "height": F.lit(100)})
    return framediff.changed_cells(cells, _before(cells), sizes)


@query
def st06_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framediff.gate(framediff.grid(fixture(spark, sf_dir, "cells")), 1, THRESHOLD)


@query
def a08_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = W.partitionBy("stream_id").orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0)
    log = framediff.gate(framediff.grid(fixture(spark, sf_dir, "cells")), 1, THRESHOLD)
    return log.select("stream_id", "frame_idx", F.sum(F.col("should_ocr").cast("long")).over(run).alias("ocr_count"), F.sum((~F.col("should_ocr")).cast("long")).over(run).alias("ocr_skipped"))


@query
def w02_sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.every_nth(read(spark, sf_dir, "events").select("event_id"), 3, "event_id")


@query
def w03_delay_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fixture(spark, sf_dir, "sticky_hits").select("stream_id", "frame_idx", "x")
    return series.delayed(hits, 3, "x")


@query
def st05_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fixture(spark, sf_dir, "sticky_hits").select("stream_id", "frame_idx", "x")
    return series.ring(hits, 4, "x").drop("x")


@query
def w04_key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "events").withColumn("down", F.col("event_type").isin("click", "view"))
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return d.withColumn("edge", series.pressed(F.col("down"), order)).where("edge").select("event_id")


@query
def l03_newest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.newest(fixture(spark, sf_dir, "sticky_hits"), "x")


@query
def a14_frame_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.frame_rate(read(spark, sf_dir, "events").withColumnRenamed("user_id", "stream_id"), "ts")


# ---- boxes and sticky hits ------------------------------------------------------------


@query
def p01_quantised_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = geometry.quantised(*[F.col(c) for c in "xywh"])
    return fixture(spark, sf_dir, "sticky_hits").select("stream_id", "frame_idx", q.alias("q")).select("stream_id", "frame_idx", "q.*")


@query
def p02_blur_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "sticky_hits").withColumns({"x": F.col("x") * 170, "y": F.col("y") * 48})
    r = geometry.blur_region(*[F.col(c) for c in "xywh"], F.lit(WIDTH), F.lit(HEIGHT))
    return d.select("stream_id", "frame_idx", r.alias("r")).select("stream_id", "frame_idx", "r.*")


@query
def p05_letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "part").select("p_partkey", geometry.letterbox(F.col("p_partkey") % 1900 + 20, F.col("p_size") * 40 + 3, 640).alias("l"))
    return d.select("p_partkey", "l.new_w", "l.new_h", "l.pad_x", "l.pad_y")


@query
def px3_preview_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "part").select("p_partkey", geometry.preview_size(F.col("p_partkey") % 1900 + 20, F.col("p_size") * 40 + 3, 1280).alias("s"))
    return d.select("p_partkey", "s.w", "s.h")


@query
def px4_downscale_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row of a preview comes from."""
    d = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40 + 3).alias("sh")).withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return d.select("p_partkey", "dy", F.floor(F.col("dy") * F.col("sh") / 10).cast("long").alias("sy"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "pictures").withColumn("bgra", F.unhex("hex")).drop("hex")


def values(frames: DataFrame, bytes_each: int, *sizes: Column, names: tuple[str, ...]) -> DataFrame:
    """Frames whose bgra holds numbers of ``bytes_each`` bytes, least first -> a row for each, with its place along each axis."""
    digits = F.hex("bgra")
    number = F.concat(*[F.substr(digits, F.col("i") * 2 * bytes_each + 1 + 2 * (bytes_each - 1 - k), F.lit(2)) for k in range(bytes_each)])
    d = frames.withColumn("i", F.explode(F.sequence(F.lit(0), (F.length("bgra") / bytes_each - 1).cast("int")))).withColumn("value", F.conv(number, 16, 10).cast("int"))
    place, out = F.col("i"), []
    for size, name in reversed(list(zip(sizes, names, strict=True))):
        out.append((place % size).cast("int").alias(name))
        place = F.floor(place / size)
    return d.select("frame_idx", *out, "value")


@query
def px1_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red and blue exchanged, either way."""
    return pixels.map_frames(pictures(spark, sf_dir), pixels.swapped).select("frame_idx", F.lower(F.hex("bgra")).alias("bytes"))


@query
def a09_cell_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.cell_hashes(pictures(spark, sf_dir), 2)


@query
def p03_blurred(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pictures(spark, sf_dir)
    whole = d.select("stream_id", "frame_idx", F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    return values(pixels.blur_frames(d, whole), 1, F.col("height"), F.col("width"), F.lit(4), names=("y", "x", "c"))


@query
def p06_letterboxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of 8 x 8 values, of 255 at most."""
    d = pixels.map_frames(pictures(spark, sf_dir), lambda p: (pixels.letterboxed(p, 8) * 255).round().astype("uint8"))
    return values(d, 1, F.lit(3), F.lit(8), F.lit(8), names=("c", "y", "x"))


@query
def px4_downscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pixels.map_frames(pictures(spark, sf_dir), lambda p: pixels.downscaled(p, 3, 2).astype("<u4"))
    return values(d, 4, F.lit(2), F.lit(3), names=("y", "x"))


@query
def p07_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "sticky_hits").select("stream_id", "frame_idx", F.struct(*"xywh").alias("a"))
    order = W.partitionBy("stream_id").orderBy("frame_idx")
    return d.withColumn("b", F.lag("a").over(order)).where("b is not null").select("stream_id", "frame_idx", geometry.iou(F.col("a"), F.col("b")).alias("iou"))


@query
def st01_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sticky.expiries(fixture(spark, sf_dir, "sticky_hits"))


@query
def st02_sticky_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sticky.intervals(fixture(spark, sf_dir, "sticky_hits"))


@query
def st03_sticky_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sticky.active(fixture(spark, sf_dir, "sticky_hits"))


@query
def j06_frames_in_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fixture(spark, sf_dir, "sticky_hits")
    return sticky.on_frames(hits.select("stream_id", (F.col("frame_idx") * 2).alias("frame_idx")).distinct(), hits)


# ---- detections -----------------------------------------------------------------------


@query
def a12_anchor_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "anchors").select("anchor", vision.best_class(F.col("scores")).alias("b"))
    return d.select("anchor", "b.class", "b.confidence", vision.class_name(F.col("b.class")).alias("name"))


@query
def p04_decoded_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.decode(fixture(spark, sf_dir, "anchors"), F.lit(WIDTH), F.lit(HEIGHT))


@query
def nms_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.suppress(p04_decoded_anchors(spark, sf_dir))


# ---- data sets ------------------------------------------------------------------------


@query
def a13_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.class_counts(vision.decode(fixture(spark, sf_dir, "anchors"), F.lit(WIDTH), F.lit(HEIGHT)))


@query
def p13_label_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bottom = F.lit(50) + F.col("p_size") * 22
    label = F.when(F.col("p_partkey") % 3 == 0, dataset.editor_label(bottom)).when(F.col("p_partkey") % 3 == 1, dataset.terminal_label(bottom)).otherwise(dataset.seed_label())
    return read(spark, sf_dir, "part").select("p_partkey", label.alias("l")).select("p_partkey", "l.*")


@query
def p14_seed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "nation").select(F.col("n_name").alias("image"), F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("words"))
    return dataset.seed_cells(d)


@query
def l02_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_name").alias("stem"), "c_custkey")
    return dataset.validation_split(c, c.where("c_custkey % 7 <> 0"), c.where("c_custkey % 11 = 0"))


@query
def a15_screenshot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src11_store_results(spark, sf_dir).groupBy("bundle").agg(F.count("*").alias("n"))
