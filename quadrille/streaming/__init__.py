"""Ordered series, ticks and Structured Streaming."""
