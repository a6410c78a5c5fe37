"""Streetloom: US postal address analytics on Spark DataFrames."""
