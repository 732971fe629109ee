"""netloom: association networks and large-corpus processing on Spark DataFrames."""
