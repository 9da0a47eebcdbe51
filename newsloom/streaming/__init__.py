"""Structured Streaming forms of the import and of the log counts."""
