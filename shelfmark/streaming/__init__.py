"""Structured Streaming forms of the scan merge and the periodic hashing."""
