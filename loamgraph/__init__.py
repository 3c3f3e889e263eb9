"""Property-graph, retrieval and event-memory analytics on Spark DataFrames."""
