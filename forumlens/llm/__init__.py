"""Operators of a training-data pipeline: each module holds one operator over whole DataFrames."""
