"""Continuous collection with Structured Streaming."""

from .collect import stream_collect

__all__ = ["stream_collect"]
