"""Structured Streaming versions of the polled refresh and the incremental index."""
