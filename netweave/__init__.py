"""netweave: network-flow analytics and corpus preparation as Spark jobs."""
