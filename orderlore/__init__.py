"""Data quality, group fairness and question analytics as Spark jobs."""
