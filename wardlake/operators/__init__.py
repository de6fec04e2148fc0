"""Joins, aggregations and ordered operators on DataFrames."""
