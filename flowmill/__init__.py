"""Network-traffic features, datasets and evaluation as Spark DataFrame jobs."""
