"""Finding and masking secrets in streams of recognised screen text, on Spark."""
