"""Column expressions: time axis, text, keys, statistics."""
