"""Data quality and machine-learning preparation on Spark DataFrames."""

__version__ = "0.1.0"
