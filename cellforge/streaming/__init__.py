"""Structured Streaming forms of the leaf aggregation."""
