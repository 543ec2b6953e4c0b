"""Site and document analytics on Spark DataFrames."""
