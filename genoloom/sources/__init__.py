"""Readers: each gives a DataFrame with the columns of its record kind and a row order ``_seq``."""
