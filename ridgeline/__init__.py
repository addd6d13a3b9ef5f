"""Outdoor-route analytics and training-data preparation on Spark DataFrames."""
