"""Readers, sinks and digests."""
