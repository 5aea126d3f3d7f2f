"""Structured Streaming versions of the operators that are naturally streams."""
