"""Sources by name, and sinks."""
