"""Content-signature analytics on Spark DataFrames."""
