"""All queries of the engine's own operators over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from .plans import queries_files, queries_graph, queries_more, queries_rows  # noqa: F401

QUERIES = {**queries_graph.QUERIES}
ORACLE = {**queries_graph.ORACLE}
