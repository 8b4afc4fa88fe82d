"""basewise: k-mer analytics on Spark DataFrames."""
