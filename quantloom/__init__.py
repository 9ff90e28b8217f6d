"""Market-research analytics as PySpark jobs."""
