"""Structured Streaming: record programs over unbounded input."""
