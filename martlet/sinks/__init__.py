"""Sinks: staged publish of marts, append-only logs."""
