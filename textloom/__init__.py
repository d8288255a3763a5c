"""Text analytics and retrieval on Spark DataFrames."""
