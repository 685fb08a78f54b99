"""Sources of netweave."""
