"""Citation-based trust estimation over revision histories, as PySpark DataFrame functions."""
