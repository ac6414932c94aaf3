"""Search and stock-taking of large document collections on Spark DataFrames."""
