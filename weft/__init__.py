"""Co-interaction graph analytics on Spark DataFrames."""
