"""User-level data operators on Spark DataFrames and streams."""
