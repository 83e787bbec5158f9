"""Queries over the standard tables, one or more for each operator."""

from weft.plans import files, graph, kept, more, retrieval, scalar, tables
from weft.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "files", "graph", "kept", "more", "retrieval", "scalar", "tables"]
