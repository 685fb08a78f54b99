"""Operators of netweave."""
