"""Graph-clustering analytics on Spark DataFrames."""
