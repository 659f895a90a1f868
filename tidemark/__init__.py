"""Tidemark: analytics for irregular bedside time series, on Spark DataFrames."""
