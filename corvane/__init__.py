"""Corvane: typed resource search, change-log algebra and analytics on Spark DataFrames."""

__version__ = "0.1.0"
