"""Document knowledge bases on Spark DataFrames."""
