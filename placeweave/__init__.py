"""placeweave: hierarchical address resolution and corpus analytics on Spark DataFrames."""
