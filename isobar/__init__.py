"""Gridded weather data as Spark DataFrames."""
