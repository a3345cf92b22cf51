"""DuckDB SQL of the queries that have it."""

from __future__ import annotations

from . import queries  # noqa: F401 - registers
from .registry import ORACLES


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
