"""Panel factor analytics on Spark DataFrames."""
