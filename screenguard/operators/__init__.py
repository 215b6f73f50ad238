"""Relational operators over frames, recognised lines, hits and detections."""
