"""cuelake: timed-text analytics as Spark DataFrame jobs."""
