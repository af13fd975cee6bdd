"""Time-series features over Spark DataFrames."""
