"""Scalar functions over text, numbers and vectors, as native column expressions."""
