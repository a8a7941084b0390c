"""Structured Streaming forms of the daily operators."""
