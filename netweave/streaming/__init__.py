"""Streaming of netweave."""
