"""Registered queries of the curation library and their SQL."""

from __future__ import annotations

from corpusloom.plans import auditing, curation, files, scoring
from corpusloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "auditing", "curation", "files", "scoring"]
