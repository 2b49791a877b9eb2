"""passagekit: passage retrieval and text analytics on Spark DataFrames."""
