"""curbside: listing and post analytics as Spark DataFrame jobs."""
