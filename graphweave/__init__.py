"""graphweave: analytics over collections of labelled scene graphs, on Spark DataFrames."""
