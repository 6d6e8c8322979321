"""Credit-monitoring analytics as PySpark DataFrame operators."""
