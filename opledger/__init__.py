"""Operation-log, scheduling and serving analytics on Spark DataFrames."""
