"""Protein-family data and stability changes as Spark DataFrames."""
