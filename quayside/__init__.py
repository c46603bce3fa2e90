"""Cross-venue market analytics as Spark jobs."""
