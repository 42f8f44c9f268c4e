"""Road-checkpoint camera analytics expressed as Spark DataFrame jobs."""
