"""Structured Streaming forms of operators whose state is bounded by key."""
