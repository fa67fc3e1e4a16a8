"""namefold: entity matching across two versions of a renamed graph, on Spark DataFrames."""
