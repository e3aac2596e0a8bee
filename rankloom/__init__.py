"""Ranked-retrieval analytics on Spark DataFrames."""
