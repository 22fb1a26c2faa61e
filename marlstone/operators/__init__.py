"""Operators on DataFrames, one module for each subject."""
