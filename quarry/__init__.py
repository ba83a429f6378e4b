"""quarry: code-graph and text analytics on Spark DataFrames."""
