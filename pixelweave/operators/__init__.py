"""Operators over pixels, groups, decisions and training rows, each a function from DataFrames to a DataFrame."""
