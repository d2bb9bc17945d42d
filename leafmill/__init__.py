"""leafmill: document-layout analytics on Spark DataFrames."""
