"""Relational and numerical operators on DataFrames."""
