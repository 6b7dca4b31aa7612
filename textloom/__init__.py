"""textloom: corpus processing on Spark DataFrames."""
