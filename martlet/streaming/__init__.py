"""Structured Streaming variants of the pipeline stages."""
