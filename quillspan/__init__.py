"""Quote location, coverage and corpus operators as Spark DataFrame jobs."""
