"""lintweave: document-quality analytics on Spark DataFrames."""
