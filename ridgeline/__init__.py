"""Sparse structured regression, inference and graphical models on Spark DataFrames."""

__version__ = "0.1.0"
