"""Registered queries of the corpus operators, with their DuckDB SQL."""
