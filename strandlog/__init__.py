"""Log-template analytics and large-scale data processing on Spark DataFrames."""
