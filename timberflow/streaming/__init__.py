"""Structured Streaming forms of the ingest, anomaly and alert jobs."""
