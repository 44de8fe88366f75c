"""Payment-integrity analytics on Spark DataFrames."""
