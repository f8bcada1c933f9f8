"""A document store with ranked full-text search, made of Spark DataFrames."""
