"""Structured Streaming variant of the trip ingest (new files processed once)."""
