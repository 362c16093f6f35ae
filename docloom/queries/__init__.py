"""Queries over the test tables, one or more for each operator of the inventory, with SQL where SQL can express them."""

from __future__ import annotations

from docloom.queries import catalog, files, plans, retrieval, scans, scoped, sqlsurface, structured, upkeep, words

MODULES = (retrieval, catalog, scoped, sqlsurface, structured, files, words, upkeep, plans, scans)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
