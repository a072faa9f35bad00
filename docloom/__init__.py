"""Document retrieval, quality and lifecycle analytics expressed as Spark jobs."""
