"""Structured Streaming forms of the cascade (T1) and of de-duplication."""

from vetta.streaming.moderate import dedup_stream, keep_first_stream, moderate_stream  # noqa: F401
