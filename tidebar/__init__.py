"""Market-data and strategy-research operators for Spark DataFrames."""

__version__ = "0.1.0"
