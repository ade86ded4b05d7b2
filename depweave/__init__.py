"""Package-dependency analytics as DataFrame, SQL and Structured Streaming jobs."""
