"""Column expressions: native, so that they stay inside generated code."""
