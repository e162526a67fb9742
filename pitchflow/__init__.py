"""Match-tracking analytics as Spark DataFrame jobs."""
