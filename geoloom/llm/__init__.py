"""Operators for large-scale training-data pipelines, each one self-contained and built on DataFrames."""
