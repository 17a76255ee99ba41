"""Market-anomaly analytics as Spark DataFrame and Structured Streaming jobs."""
