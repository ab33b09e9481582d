"""Structured Streaming: incremental ingest, run events, probe streaks."""
