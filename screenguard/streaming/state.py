"""The gate, sticky hits and the delay line over streams, one small state a key.

Each is keyed by stream (and box), takes rows of a trigger in frame order, and gives in
append mode what its batch twin gives over the same rows, as long as a stream's frames
come in order from trigger to trigger. ``idle``: milliseconds without rows after which a
key's state goes, and what comes later starts anew; by default it stays. With it Spark runs
batches without rows too, so a query ends only when it is stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geometry import quantised
from ..operators.framediff import MOST_SKIPS, step
from ..operators.sticky import BOX, LIFETIME
from ..schemas import GATE_LOG
from ..session import ready


def _idle(state: GroupState, idle: int | None) -> bool:
    """Drop the state of a key that timed out, else let it live on for ``idle`` milliseconds; whether it was dropped."""
    if idle is None:
        return False
    if state.hasTimedOut:
        state.remove()
        return True
    state.setTimeoutDuration(idle)
    return False


def _timeout(idle: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


def gate_stream(frames: DataFrame, every: int = 3, threshold: float = 0.0, most_skips: int = MOST_SKIPS, idle: int | None = None) -> DataFrame:
    """Streaming frames (stream_id, frame_idx, cols, rows, cells, and failed if there is one) -> the gate's log."""
    if every < 1:
        raise ValueError("every must be at least 1")
    ready(frames.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _idle(state, idle):
            return
        held = json.loads(state.get[0]) if state.exists else [None, None, 0]
        now = (held[0], tuple(held[1]) if held[1] else None, held[2])
        out = []
        for r in pd.concat(parts).sort_values("frame_idx").itertuples():
            now, log = step(now, r.frame_idx, list(r.cells), (r.cols, r.rows), every, threshold, most_skips, r.failed)
            out.append((key[0], r.frame_idx, *log))
        state.update((json.dumps(now),))
        d = pd.DataFrame(out, columns=["stream_id", "frame_idx", "sampled", "changed", "should_ocr", "consecutive_skips"])
        yield d.astype({"changed": "float32"})

    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in frames.columns else F.lit(False)
    d = frames.select("stream_id", "frame_idx", "cols", "rows", F.col("cells").cast("array<string>").alias("cells"), failed.alias("failed"))
    return d.groupBy("stream_id").applyInPandasWithState(run, GATE_LOG, "held string", "append", _timeout(idle))


def sticky_stream(hits: DataFrame, lifetime: int = LIFETIME, idle: int | None = None) -> DataFrame:
    """Streaming hits -> (stream_id, frame_idx, box): frames a box is newly known to be alive at, each once."""
    ready(hits.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _idle(state, idle):
            return
        expiry = state.get[0] if state.exists else -1
        out = []
        for f in sorted(int(f) for p in parts for f in p["frame_idx"]):
            out += [(key[0], t, *key[1:]) for t in range(max(f, expiry), f + lifetime)]
            expiry = max(expiry, f + lifetime)
        state.update((expiry,))
        yield pd.DataFrame(out, columns=["stream_id", "frame_idx", *BOX])

    d = hits.select("stream_id", "frame_idx", quantised(*[F.col(c) for c in BOX]).alias("q")).select("stream_id", "frame_idx", "q.*")
    return d.groupBy("stream_id", *BOX).applyInPandasWithState(run, "stream_id bigint, frame_idx bigint, x bigint, y bigint, w bigint, h bigint", "expiry bigint", "append", _timeout(idle))


def delay_stream(frames: DataFrame, capacity: int, value: str, idle: int | None = None) -> DataFrame:
    """Streaming frames -> (stream_id, frame_idx, tail): the value that leaves a buffer of ``capacity``, as text."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    ready(frames.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _idle(state, idle):
            return
        held = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(parts).sort_values("frame_idx").itertuples():
            held = [*held, r.value][-capacity:]
            out.append((key[0], r.frame_idx, held[0] if len(held) == capacity else None))
        state.update((held,))
        yield pd.DataFrame(out, columns=["stream_id", "frame_idx", "tail"])

    d = frames.select("stream_id", "frame_idx", F.col(value).cast("string").alias("value"))
    return d.groupBy("stream_id").applyInPandasWithState(run, "stream_id bigint, frame_idx bigint, tail string", "held array<string>", "append", _timeout(idle))
