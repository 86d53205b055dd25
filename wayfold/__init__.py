"""Road-network analytics and corpus preparation as Spark jobs."""
