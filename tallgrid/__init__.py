"""Table harmonisation and quality analytics on Spark DataFrames."""
