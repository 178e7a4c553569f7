"""weftline: graph and text analytics on Spark DataFrames."""
