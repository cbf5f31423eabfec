"""Exploratory statistics and training-data preparation on Spark DataFrames."""
