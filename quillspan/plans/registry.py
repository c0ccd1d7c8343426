"""All core queries and their SQL, by name."""

from __future__ import annotations

import importlib

_MODULES = [
    importlib.import_module(f"quillspan.plans.{m}")
    for m in ("incremental", "lookups", "aggregates", "scalars", "history", "graph", "retrieval", "context", "writes", "parsing", "streams", "evaluation", "further", "edges", "stored", "stages", "analysis", "parts")
]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
FLAGSHIP = "ret25_hybrid_search"
