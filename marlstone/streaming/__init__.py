"""Structured Streaming forms of the cache and of the coalescing of requests."""
