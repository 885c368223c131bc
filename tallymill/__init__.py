"""Usage metering and rating on Spark DataFrames."""
