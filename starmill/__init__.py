"""Particle analytics on Spark DataFrames."""
