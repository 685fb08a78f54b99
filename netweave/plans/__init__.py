"""Plans of netweave."""
