"""Operators for training data, each from DataFrames to DataFrames; nothing else in the library imports this package."""
