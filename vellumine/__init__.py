"""Document structuring, scoring and training-data operators as PySpark DataFrame transforms."""
