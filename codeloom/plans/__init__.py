"""The queries that the library registers, with their SQL oracles."""

from __future__ import annotations

from . import history, retrieve, search, sessions, structure

QUERIES: dict = history.QUERIES | structure.QUERIES | retrieve.QUERIES | sessions.QUERIES | search.QUERIES
ORACLES: dict[str, str] = history.ORACLES | structure.ORACLES | retrieve.ORACLES | sessions.ORACLES | search.ORACLES
