"""Loaders: a declared input and a place to a set-valued DataFrame in the declared types."""
