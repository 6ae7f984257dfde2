"""Price matching of purchase-order lines against web listings, on Spark DataFrames."""
