"""Structured Streaming versions of mergeable summaries."""
