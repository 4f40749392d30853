"""Attribute values as small integers and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemend.spec import YES_NO


def _literal_map(pairs: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def label_encoder(values: Sequence[str]) -> dict[str, int]:
    """Yes/No become 1/0; other classes count down to 0 in the given order."""
    if set(values) & set(YES_NO):
        return dict(YES_NO)
    return {v: len(values) - 1 - i for i, v in enumerate(values)}


def encode(value: Column, encoder: Mapping[str, int]) -> Column:
    """The code of ``value``; null where it is not a known class."""
    return F.try_element_at(_literal_map(encoder), value)


def decode(code: Column, encoder: Mapping[str, int]) -> Column:
    return F.try_element_at(_literal_map({c: v for v, c in encoder.items()}), code)


def yes_no(value: Column) -> Column:
    return F.when(value == "Yes", 1).when(value == "No", 0)
