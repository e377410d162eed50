"""Analytics over content-addressed artifact registries, on Spark DataFrames."""
