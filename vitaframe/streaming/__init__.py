"""Structured Streaming over Bulk NDJSON folders: `stream_ndjson`, with line numbers."""

from ..sources.ndjson import stream_ndjson

__all__ = ["stream_ndjson"]
