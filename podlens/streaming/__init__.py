"""Structured Streaming jobs, sinks and the tail source."""
