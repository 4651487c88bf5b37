"""Industrial knowledge and reliability analytics expressed as Spark jobs."""
