"""Whole runs: from frames or lines to hits, boxes and blurred frames."""
