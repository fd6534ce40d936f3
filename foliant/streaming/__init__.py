"""Structured Streaming forms of the running counters."""
