"""Operators on routes, places and feeds: DataFrames in, DataFrames out."""
