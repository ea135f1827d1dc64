"""Document analytics on Spark: files as tables, decoded to DataFrames."""
