"""Frame-sequence analytics as Spark jobs."""
