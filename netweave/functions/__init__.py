"""Functions of netweave."""
