"""Every registered query with its SQL."""

from __future__ import annotations

from codeloom.plans import code, graph, relational, shaping, text, vector

_PARTS = (vector, relational, text, graph, code, shaping)
QUERIES = {k: q for p in _PARTS for k, q in p.QUERIES.items()}
ORACLE = {k: s for p in _PARTS for k, s in p.ORACLE.items()}
