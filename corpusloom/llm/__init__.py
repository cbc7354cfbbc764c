"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; ``corpusloom.llm.queries`` holds
the registered queries and their SQL.
"""
