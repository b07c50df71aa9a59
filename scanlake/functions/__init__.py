"""Column expressions: all built-in, so they stay inside generated code."""
