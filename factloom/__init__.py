"""factloom: build, clean and query text memories with Spark DataFrames."""
