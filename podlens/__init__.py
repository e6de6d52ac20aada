"""Container-log and service-indicator analytics on Spark DataFrames."""
