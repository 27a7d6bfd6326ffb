"""Structured Streaming form of the observation ingest."""
