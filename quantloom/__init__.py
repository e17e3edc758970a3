"""Factor research as Spark jobs."""
