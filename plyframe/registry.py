"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from plyframe import io_queries, queries
from plyframe.games import queries as games

QUERIES, ORACLES = dict(queries.QUERIES), dict(queries.ORACLES)

__all__ = ["ORACLES", "QUERIES", "games", "io_queries"]
