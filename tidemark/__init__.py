"""Volatility analytics and time-series data preparation on Spark."""

__version__ = "0.1.0"
