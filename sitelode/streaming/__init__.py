"""Structured Streaming forms of the event and submission jobs."""
