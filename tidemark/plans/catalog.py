"""Every query of the library by name, and SQL that gives the same rows."""

from __future__ import annotations

from . import curves, decoding, evidence, learning, matching, pages, records, relational, similarity, statistics, structure, timeline

PARTS = (relational, timeline, evidence, structure, curves, matching, similarity, pages, decoding, learning, records, statistics)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
