"""Vector search, hybrid ranking, in-engine learning and text analytics on Spark DataFrames."""
