"""Headwater: hydrologic analytics on Spark DataFrames."""
