"""Structured Streaming forms of landing and of the bar aggregations."""
