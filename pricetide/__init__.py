"""Price and stock analytics on Spark DataFrames."""
