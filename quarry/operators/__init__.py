"""Operators, each from DataFrames to a DataFrame and over a batch of questions."""
