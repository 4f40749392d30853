"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from tablemend.catalog.base import REGISTRY, Query
from tablemend.catalog import (  # noqa: F401  (importing registers)
    checks,
    evaluation,
    joining,
    learning,
    mining,
    repairing,
    scans,
    summaries,
    texts,
)

__all__ = ["REGISTRY", "Query"]
