"""Scores of approximate functional dependencies, computed with Spark DataFrames."""
