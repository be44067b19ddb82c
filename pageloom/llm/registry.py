"""The subpackage's queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("html_text", "quality_rules", "decontaminate", "line_dedup", "context_tree", "packing", "ngram_join", "quality_classifier", "substring_dedup", "toxicity")
_loaded = [importlib.import_module(f"{__package__}.{m}") for m in MODULES]
QUERIES = {k: f for m in _loaded for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _loaded for k, s in m.ORACLES.items()}
