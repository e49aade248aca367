"""Trade-tape analytics as Spark DataFrame jobs."""
