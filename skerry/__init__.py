"""Vector search, proximity-graph indexes and their evaluation on Spark DataFrames."""
