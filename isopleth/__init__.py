"""Spatial statistics on Spark: layers, neighbourhood graphs and operators as DataFrames."""
