"""cellforge: hierarchical aggregation of 3-D points on Spark DataFrames."""
