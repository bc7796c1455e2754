"""Structured Streaming forms of the continuous jobs."""
