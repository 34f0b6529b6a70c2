"""Character and relationship graphs from long texts, as PySpark DataFrames."""
