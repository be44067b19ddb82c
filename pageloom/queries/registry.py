"""All queries of the library outside ``llm``."""

from __future__ import annotations

from . import assembly, documents, layout, more, tables, text

MODULES = (text, layout, tables, documents, more, assembly)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
