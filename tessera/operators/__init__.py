"""Spatial operators over DataFrames keyed by id."""
