"""Operators for large-scale training-data pipelines (numbered 1 to 10) on Spark DataFrames."""
