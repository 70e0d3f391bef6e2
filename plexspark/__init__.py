"""Graph analytics on Spark DataFrames, and operators for training data."""
