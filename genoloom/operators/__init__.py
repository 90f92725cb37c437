"""Genomic table operators. Each takes and returns DataFrames."""
