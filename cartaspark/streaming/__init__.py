"""Incremental maintenance of bounds with Structured Streaming."""
