"""Keyed time-series research on Spark: quality, features, signals, backtests, significance."""
