"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from strokeloom.plans import ingest, sessions, trajectories

QUERIES = trajectories.QUERIES | sessions.QUERIES | ingest.QUERIES
ORACLE_SQL = trajectories.ORACLE_SQL | sessions.ORACLE_SQL | ingest.ORACLE_SQL
