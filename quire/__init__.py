"""quire: analyse and transform book-like document collections with Spark DataFrames."""
