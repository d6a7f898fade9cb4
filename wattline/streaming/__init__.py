"""Incremental load of landed payload files with Structured Streaming."""
