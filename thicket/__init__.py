"""thicket: property-graph, retrieval and governance analytics on PySpark DataFrames."""
