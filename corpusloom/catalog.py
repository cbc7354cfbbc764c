"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from corpusloom.queries import answers, jobs, store, structure, text, vectors
from corpusloom.queries.base import Query

_MODULES = (text, store, vectors, structure, answers, jobs)

QUERIES: dict[str, Query] = {name: query for m in _MODULES for name, query in m.R.queries.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.R.sql.items()}
