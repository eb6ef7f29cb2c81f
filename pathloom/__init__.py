"""A property-graph query engine on Spark DataFrames."""
