"""Statistical work on large tables, expressed as Spark jobs."""
