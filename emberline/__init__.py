"""Episode and code-corpus analytics on Spark DataFrames."""
