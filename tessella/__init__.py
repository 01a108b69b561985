"""Tessella: corpus analytics as lazy Spark DataFrames."""
