"""Document-structuring analytics on Spark DataFrames."""
