"""Structured Streaming versions of the batch jobs."""
