"""Shell command history analytics on Spark DataFrames."""
