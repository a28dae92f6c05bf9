"""Structured Streaming into tables."""

from .sink import TableSink, first_within_watermark

__all__ = ["TableSink", "first_within_watermark"]
