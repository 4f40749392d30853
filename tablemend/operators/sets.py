"""Stacking of tables and their common columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def stack(tables: Sequence[DataFrame], missing: bool = False) -> DataFrame:
    """All rows of all tables, columns by name; ``missing`` fills absent columns with null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=missing), tables)


def shared_columns(tables: Sequence[DataFrame]) -> list[DataFrame]:
    """The tables cut to the columns that all of them have, in the first one's order."""
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return [t.select(*common) for t in tables]
