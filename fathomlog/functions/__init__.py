"""Scalar functions of the language on columns."""
