"""Code and operations analytics on Spark: DataFrames in, DataFrames out."""
