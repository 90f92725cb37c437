"""Scalar functions and expressions as Catalyst expressions."""
