"""Structured Streaming forms of the running metrics and windows."""
