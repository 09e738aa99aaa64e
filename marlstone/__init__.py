"""marlstone: sample-by-feature tables, positional joins, vectors and statistics as Spark DataFrames."""
