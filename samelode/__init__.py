"""Content-deduplication analytics on Spark DataFrames."""
