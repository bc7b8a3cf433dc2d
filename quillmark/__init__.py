"""Text provenance analytics as Spark jobs."""
