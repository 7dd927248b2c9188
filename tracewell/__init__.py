"""Customer-event analytics on Spark DataFrames."""
