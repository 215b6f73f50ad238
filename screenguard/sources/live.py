"""Live frames as a Spark data source: a capture function, named by an option, feeds a batch or a stream.

``spark.dataSource.register(CapturedFrames)``, then
``spark.readStream.format("captured_frames").option("capture", "module:function")``. The
function takes (stream_id, first, count) and gives up to ``count`` frames (frame_idx, width,
height, bgra) from number ``first`` on, in order; fewer mean that no more are there yet.
Options: streams (1), frames a read (64), and for a batch how many frames in all (frames).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import FRAMES


def capture_function(name: str) -> Callable:
    """The function that an option names; ValueError for one that isn't there."""
    module, _, function = name.partition(":")
    found = getattr(import_module(module), function, None) if module and function else None
    if found is None:
        raise ValueError(f"capture has no function {name!r}")
    return found


class Span(InputPartition):
    def __init__(self, stream: int, first: int, count: int):
        super().__init__((stream, first, count))
        self.stream, self.first, self.count = stream, first, count


def _rows(capture: str, span: Span) -> Iterator[tuple]:
    for frame, width, height, bgra in capture_function(capture)(span.stream, span.first, span.count):
        yield span.stream, frame, width, height, bytes(bgra), datetime.now(timezone.utc)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.capture, self.streams, self.frames = options["capture"], int(options.get("streams", 1)), int(options.get("frames", 64))

    def partitions(self) -> list[Span]:
        return [Span(s, 0, self.frames) for s in range(self.streams)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return _rows(self.capture, partition)


class _Stream(DataSourceStreamReader):
    """Offsets are frame numbers; every read asks each stream for the same span, one task a stream."""

    def __init__(self, options: dict):
        self.capture, self.streams, self.frames = options["capture"], int(options.get("streams", 1)), int(options.get("frames", 64))
        self.next = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.next += self.frames
        return {"frame": self.next}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.next = max(self.next, end["frame"])
        return [Span(s, start["frame"], end["frame"] - start["frame"]) for s in range(self.streams)] if end["frame"] > start["frame"] else []

    def read(self, partition: Span) -> Iterator[tuple]:
        return _rows(self.capture, partition)

    def commit(self, end: dict) -> None:
        pass


class CapturedFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(self.options)


def test_pattern(stream: int, first: int, count: int) -> Iterator[tuple]:
    """Frames of one grey each, for trying things out."""
    for f in range(first, first + count):
        yield f, 4, 2, bytes([f % 256, f % 256, f % 256, 255]) * 8


test_pattern.__test__ = False
