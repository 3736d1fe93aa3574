"""Whole jobs made of the operators: indexing and search."""
