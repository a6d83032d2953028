"""textlab: comparative text-corpus analytics on Spark DataFrames."""
