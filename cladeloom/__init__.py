"""Phylogenetic likelihood analytics on Spark DataFrames."""
