"""Rows, stitched values, the gate, sticky hits and suppression against plain Python models."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from screenguard import schemas, words
from screenguard.functions import geometry, hashing, text
from screenguard.operators import framediff, rows, series, sticky, vision

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def merge_model(lines):
    out = []
    for no, y, h in lines:
        cy = np.float32(y) + np.float32(h) / np.float32(2)
        for i, (centres, most) in enumerate(out):
            total = np.float32(0)
            for c in centres:
                total += c
            if abs(cy - total / np.float32(len(centres))) <= max(np.float32(max(h, most)) * np.float32(0.6), np.float32(6)):
                out[i] = (centres + [cy], max(most, h))
                yield no, i
                break
        else:
            out.append(([cy], h))
            yield no, len(out) - 1


@SLOW
@given(st.lists(st.lists(st.tuples(st.integers(0, 120), st.integers(1, 30)), max_size=15), min_size=1, max_size=12))
def test_rows_join_like_the_model(spark, frames):
    data = [(f, i, "t", 0, y, 5, h) for f, lines in enumerate(frames) for i, (y, h) in enumerate(lines)]
    got = rows.assign_rows(spark.createDataFrame(data, schemas.OCR_LINES)).select("frame_idx", "line_no", "row_id").collect()
    want = {(f, no, r) for f, lines in enumerate(frames) for no, r in merge_model([(i, y, h) for i, (y, h) in enumerate(lines)])}
    assert {tuple(r) for r in got} == want


def stitch_model(items):
    items = sorted(items, key=lambda r: (r[1], r[0]))
    i, hit = 0, set()
    while i < len(items):
        if items[i][3] < 8:
            i += 1
            continue
        j, total = i + 1, items[i][3]
        while j < len(items):
            gap = items[j][1] - (items[j - 1][1] + items[j - 1][2])
            if gap > max(items[j - 1][2], items[j][2]) or gap < -items[j][2] or items[j][3] < 8:
                break
            total += items[j][3]
            j += 1
        if j - i >= 2 and total in rows.STITCHED:
            hit |= {r[0] for r in items[i:j]}
        i = j
    return hit


@SLOW
@given(st.lists(st.lists(st.tuples(st.integers(0, 100), st.integers(8, 20), st.sampled_from([4, 8, 12, 16, 20, 32])), max_size=10), min_size=1, max_size=15))
def test_stitch_like_the_model(spark, frames):
    data = [(f, i, "a" * n, 0, y, 5, h) for f, items in enumerate(frames) for i, (y, h, n) in enumerate(items)]
    got = rows.hex_stitch(spark.createDataFrame(data, schemas.MERGED_ROWS)).collect()
    want = {(f, r) for f, items in enumerate(frames) for r in stitch_model([(i, y, h, n) for i, (y, h, n) in enumerate(items)])}
    assert {(r["frame_idx"], r["row_id"]) for r in got} == want


@pytest.mark.parametrize("total", [38, 39, 41, 42, 62, 63, 65, 66])
def test_stitch_totals_and_gap(spark, total):
    data = [(0, 0, "a" * 20, 0, 0, 5, 10), (0, 1, "b" * (total - 20), 0, 20, 5, 10), (1, 0, "a" * 20, 0, 0, 5, 10), (1, 1, "b" * (total - 20), 0, 21, 5, 10)]
    got = {r["frame_idx"] for r in rows.hex_stitch(spark.createDataFrame(data, schemas.MERGED_ROWS)).collect()}
    assert got == ({0} if total in rows.STITCHED else set())


def test_row_text_and_box(spark):
    data = [(0, 0, "b", 50, 10, 20, 10), (0, 1, "a", 5, 12, 20, 10), (0, 2, "c", 50, 11, 9, 30)]
    r = rows.merged_rows(spark.createDataFrame(data, schemas.OCR_LINES)).collect()
    assert [tuple(x) for x in r] == [(0, 0, "a b c", 5, 10, 65, 31)]


def test_detection_of_split_words(spark):
    lines = [(0, i, w, i * 50, 10, 40, 10) for i, w in enumerate("abandon ability able about above absent absorb abstract".split())]
    got = rows.detect(spark.createDataFrame(lines, schemas.OCR_LINES), words.SAMPLE).collect()
    assert [r["kind"] for r in got] == ["SeedPhrase"]


def frames_of(spark, per_stream):
    data = [(s, f, 2, 2, [str(c) for c in cells]) for s, frames in enumerate(per_stream) for f, cells in enumerate(frames)]
    return spark.createDataFrame(data, "stream_id bigint, frame_idx bigint, cols int, rows int, cells array<string>")


def gate_model(frames, every, threshold):
    then, skips = None, 0
    for f, cells in enumerate(frames):
        if f % every:
            yield f, False
            continue
        go = then is None or skips >= 3 or np.float32(sum(a != b for a, b in zip(cells, then, strict=True)) / 4) >= np.float32(threshold)
        then, skips = (cells, 0) if go else (then, skips + 1)
        yield f, go


@SLOW
@given(st.lists(st.lists(st.tuples(*[st.integers(0, 2)] * 4), min_size=1, max_size=20), min_size=1, max_size=5), st.sampled_from([1, 3]), st.sampled_from([0.0, 0.25, 0.6]))
def test_gate_like_the_model(spark, streams, every, threshold):
    got = {(r["stream_id"], r["frame_idx"], r["should_ocr"]) for r in framediff.gate(frames_of(spark, streams), every, threshold).collect()}
    assert got == {(s, f, go) for s, frames in enumerate(streams) for f, go in gate_model(frames, every, threshold)}


def test_gate_after_a_failed_recognition(spark):
    d = frames_of(spark, [[(0, 0, 0, 0), (1, 1, 1, 1), (0, 0, 0, 0)]]).withColumn("failed", F.col("frame_idx") == 1)
    log = {r["frame_idx"]: r for r in framediff.gate(d, 1, 0.5).collect()}
    assert log[1]["should_ocr"] and not log[2]["should_ocr"] and log[2]["changed"] == 0.0


def test_bad_parameters(spark):
    d = frames_of(spark, [[(0, 0, 0, 0)]])
    for f in (lambda: framediff.gate(d, 0), lambda: series.every_nth(d, 0), lambda: series.delayed(d, 0, "cols"), lambda: series.frame_period_us(0)):
        with pytest.raises(ValueError):
            f()
    assert series.frame_period_us(10) == 100_000


def test_changed_share_and_sizes(spark):
    d = spark.createDataFrame([((2, 1, ["a", "b"]), (2, 1, ["a", "c"])), ((2, 1, ["a", "b"]), (1, 2, ["a", "b"])), ((0, 0, []), (0, 0, [])), ((1, 1, ["a"]), (1, 1, ["a"]))], "n struct<cols:int,rows:int,cells:array<string>>, t struct<cols:int,rows:int,cells:array<string>>")
    assert [r[0] for r in d.select(framediff.fraction_changed(F.col("n"), F.col("t"))).collect()] == [0.5, 1.0, 0.0, 0.0]
    cells = spark.createDataFrame([(0, 0, 0, 0, "a"), (0, 0, 0, 1, "b"), (1, 0, 0, 0, "a")], schemas.CELL_HASHES)
    then = spark.createDataFrame([(0, 0, 0, 0, "a"), (0, 0, 0, 1, "x"), (1, 0, 0, 0, "a"), (1, 0, 1, 0, "a")], schemas.CELL_HASHES)
    sizes = spark.createDataFrame([(0, 0, 100, 60), (1, 0, 60, 60)], "stream_id bigint, frame_idx bigint, width int, height int")
    assert {tuple(r) for r in framediff.changed_cells(cells, then, sizes).collect()} == {(0, 0, 64, 0, 36, 60), (1, 0, 0, 0, 60, 60)}


def test_fnv(spark):
    def model(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    data = [b"", b"a", bytes(range(256)), "größe".encode()]
    got = spark.createDataFrame([(bytearray(x),) for x in data], "b binary").select(hashing.fnv1a64(F.col("b"))).collect()
    assert [r[0] for r in got] == [model(x) for x in data] and got[0][0] == "cbf29ce484222325"


def test_sticky(spark):
    hits = spark.createDataFrame([(0, 0, "k", 100, 200, 80, 20), (0, 10, "k", 101, 203, 79, 18), (0, 100, "k", 100, 200, 80, 20), (0, 130, "k", 100, 200, 80, 20)], schemas.HITS)
    got = sorted((r["start"], r["stop"]) for r in sticky.intervals(hits).collect())
    assert got == [(0, 40), (100, 160)]
    alive = {r["frame_idx"] for r in sticky.active(hits).collect()}
    assert {29, 35, 39, 159} <= alive and not {40, 99, 160} & alive
    frames = spark.createDataFrame([(0, f) for f in (0, 39, 40, 150)], "stream_id bigint, frame_idx bigint")
    assert {r["frame_idx"] for r in sticky.on_frames(frames, hits, span=16).collect()} == {0, 39, 150}


def test_sticky_active_like_a_map(spark):
    rnd = random.Random(3)
    hits = sorted((0, rnd.randrange(300), "k", rnd.choice([0, 40]), 0, 8, 8) for _ in range(20))
    want, expiry = set(), {}
    for f in range(400):
        for h in hits:
            if h[1] == f:
                expiry[h[3]] = max(expiry.get(h[3], 0), f + 30)
        want |= {(f, x) for x, e in expiry.items() if e > f}
    got = sticky.active(spark.createDataFrame(hits, schemas.HITS))
    assert {(r["frame_idx"], r["x"]) for r in got.collect()} == want


def nms_model(boxes):
    def iou(a, b):
        w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return np.float32(0)
        i = np.float32(w * h)
        return i / (np.float32(a[2] * a[3]) + np.float32(b[2] * b[3]) - i)

    kept = []
    for n, c, conf, box in sorted(boxes, key=lambda b: (-b[2], b[0])):
        if not any(k[1] == c and iou(k[3], box) > np.float32(0.5) for k in kept):
            kept.append((n, c, conf, box))
    return {k[0] for k in kept}


@SLOW
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.5, 0.8, 0.95]), st.tuples(st.integers(0, 20), st.integers(0, 20), st.integers(1, 20), st.integers(1, 20))), max_size=25))
def test_suppression_like_the_model(spark, boxes):
    boxes = [(i, *b) for i, b in enumerate(boxes)]
    data = [(0, i, c, conf, *box) for i, c, conf, box in boxes]
    got = vision.suppress(spark.createDataFrame(data, "frame_idx bigint, anchor bigint, class int, confidence float, x bigint, y bigint, w bigint, h bigint"))
    assert {r["anchor"] for r in got.collect()} == nms_model(boxes)


def test_overlap_of_exactly_half_stays(spark):
    data = [(0, 0, 3, 0.95, 0, 0, 2, 1), (0, 1, 3, 0.8, 0, 0, 1, 1), (0, 2, 3, 0.7, 0, 0, 2, 1), (0, 3, 2, 0.1, 0, 0, 2, 1)]
    got = vision.suppress(spark.createDataFrame(data, "frame_idx bigint, anchor bigint, class int, confidence float, x bigint, y bigint, w bigint, h bigint"))
    assert {r["anchor"] for r in got.collect()} == {0, 1, 3}


def test_class_and_threshold(spark):
    data = [(0, 0, 320.0, 320.0, 10.0, 10.0, [0.35, 0.35]), (0, 1, 320.0, 320.0, 10.0, 10.0, [0.1, 0.3]), (0, 2, 1.0, 320.0, 50.0, 10.0, [-1.0, 0.9]), (0, 3, 320.0, 320.0, 10.0, 10.0, [0.0] * 6 + [0.9])]
    d = vision.decode(spark.createDataFrame(data, schemas.ANCHORS), F.lit(640), F.lit(640))
    assert {(r["anchor"], r["class"], r["x"], r["w"]) for r in d.collect()} == {(0, 0, 315, 10), (2, 1, 0, 26)}
    b = spark.createDataFrame([([-1.0, -2.0],)], "s array<float>").select(vision.best_class(F.col("s")).alias("b")).first()["b"]
    assert tuple(b) == (0, 0.0) and vision.CLASSES[3] == "env_file_editor"


def test_boxes(spark):
    q = spark.range(1).select(geometry.quantised(F.lit(101), F.lit(203), F.lit(80), F.lit(21)).alias("q")).first()["q"]
    assert tuple(q) == (100, 200, 80, 24)
    r = spark.range(1).select(geometry.blur_region(F.lit(5), F.lit(1075), F.lit(80), F.lit(21), F.lit(1920), F.lit(1080)).alias("r")).first()["r"]
    assert tuple(r) == (0, 1059, 128, 21)
    names = spark.range(1).select(text.frame_name(F.lit(7)), text.terminal_line(F.lit("A=b")), text.bundle_name(F.lit("a.b"))).first()
    assert tuple(names) == ("frame_00007.png", "$env:A = 'b'", "a_b")
