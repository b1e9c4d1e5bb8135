"""tastemap: batch product recommendation and catalogue analytics on Spark DataFrames."""

__version__ = "0.1.0"
