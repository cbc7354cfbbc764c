"""Whole jobs composed of operators: index maintenance and retrieval."""
