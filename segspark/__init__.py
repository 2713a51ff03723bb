"""Spark-first analytics over one-dimensional coordinate data: intervals, step functions, windows, models and resampling."""
