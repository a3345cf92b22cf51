"""All queries of the engine, by name."""

from __future__ import annotations

from . import build, calls, corpus, decisions, dialogue, documents, incremental, parsed, records, retrieval, sources  # noqa: F401 - importing registers
from .registry import QUERIES

hybrid_search = retrieval.hybrid_search


def queries():
    return dict(QUERIES)
