"""Schemas of the package's tables. Line, row and anchor numbers are explicit: their order has meaning."""

from __future__ import annotations

BOX = "x bigint, y bigint, w bigint, h bigint"
FRAMES = "stream_id bigint, frame_idx bigint, width int, height int, bgra binary, captured_at timestamp"
OCR_WORDS = "frame_idx bigint, line_no int, word_no int, x float, y float, w float, h float"
OCR_LINES = f"frame_idx bigint, line_no bigint, text string, {BOX}"
MERGED_ROWS = f"frame_idx bigint, row_id bigint, text string, {BOX}"
HITS = f"stream_id bigint, frame_idx bigint, kind string, {BOX}"
STICKY_ACTIVE = f"stream_id bigint, frame_idx bigint, {BOX}"
CELL_HASHES = "stream_id bigint, frame_idx bigint, cy int, cx int, hash string"
GATE_LOG = "stream_id bigint, frame_idx bigint, sampled boolean, changed float, should_ocr boolean, consecutive_skips int"
ANCHORS = "frame_idx bigint, anchor bigint, cx float, cy float, w float, h float, scores array<float>"
DETECTIONS = f"frame_idx bigint, class int, confidence float, {BOX}"
YOLO_LABELS = "image string, class int, xc double, yc double, w double, h double"
WINDOWS = "frame_idx bigint, title string, process_name string, left int, top int, right int, bottom int"
STORE_RESULTS = "struct<results: array<struct<bundleId: string, trackName: string, screenshotUrls: array<string>, ipadScreenshotUrls: array<string>>>>"
