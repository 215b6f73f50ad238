"""What a run is asked to do."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.series import frame_period_us


@dataclass(frozen=True)
class RunConfig:
    """Options of a run, with their defaults. Numbers that make no run raise ValueError."""

    record_seconds: int = 0
    fps: int = 10
    ocr_every: int = 3
    diff_skip_threshold: float = 0.0
    preview: bool = False
    preview_width: int = 1280
    collect: str | None = None
    verbose: bool = False

    def __post_init__(self) -> None:
        if self.ocr_every < 1 or self.preview_width < 1 or self.record_seconds < 0:
            raise ValueError("ocr_every and preview_width must be at least 1, record_seconds at least 0")
        frame_period_us(self.fps)

    @property
    def mode(self) -> str:
        """collect before preview before record before a single shot."""
        if self.collect:
            return "collect"
        if self.preview:
            return "preview"
        return "record" if self.record_seconds else "single"

    @property
    def frames(self) -> int:
        """Frames of a recording."""
        return self.record_seconds * self.fps

    @property
    def trigger(self) -> str:
        """A stream's processing time between frames."""
        return f"{max(1, frame_period_us(self.fps) // 1000)} milliseconds"
