"""Associative-memory analytics on PySpark: DataFrame in, DataFrame out."""
