"""Structured Streaming jobs over ticks and quotes."""
