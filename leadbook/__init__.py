"""Lead-book analytics on Spark DataFrames."""
