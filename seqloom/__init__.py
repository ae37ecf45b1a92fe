"""Ordered-sequence, segment and graph operations on Spark DataFrames."""

__version__ = "0.1.0"
