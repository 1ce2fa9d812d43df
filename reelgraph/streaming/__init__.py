"""Continuous ingest and keyed state with Structured Streaming."""
