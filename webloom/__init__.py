"""webloom: web-content retrieval and training-data preparation on Spark DataFrames."""
