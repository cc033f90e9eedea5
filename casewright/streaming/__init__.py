"""Structured Streaming over the result log."""
