"""Structured Streaming forms of the loader and counters."""
