"""Text-corpus and vector analytics as Spark DataFrame jobs."""
