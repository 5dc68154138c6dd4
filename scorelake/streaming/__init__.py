"""Incremental processing of arriving responses with Structured Streaming."""
