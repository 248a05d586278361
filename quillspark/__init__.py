"""Multi-model analytics on Spark: relational, vector, text, graph and table operators as DataFrames."""
