"""Content, catalogue and queue analytics as PySpark DataFrames."""
