"""Operators for large-scale training-data pipelines, built on Spark DataFrames."""
