"""Evidence for an attribute in free text, and age intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemend.spec import AGE_LABELS, POPULATION_PHRASES

# The edge of a word, spelled out: what ``\b`` means differs between Java versions.
EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


def any_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """True where one of the phrases (regular expressions) occurs as whole words, ignoring case."""
    joined = "|".join(f"(?:{p})" for p in phrases)
    return F.coalesce(F.lower(text).rlike(rf"(?i){EDGE}(?:{joined}){EDGE}"), F.lit(False))


def age_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """True where a phrase is followed by a word of age, as in ``65 years``."""
    joined = "|".join(f"(?:{p})" for p in phrases)
    return F.coalesce(F.lower(text).rlike(rf"(?i){EDGE}(?:{joined})\s(?:age|years| of years)+{EDGE}"), F.lit(False))


def evidence_for(text: Column, label: str, corpus: Mapping[str, Sequence[str]] = POPULATION_PHRASES) -> Column:
    """Dictionary evidence for ``label``; a label without phrases has none."""
    return any_phrase(text, corpus[label]) if label in corpus else F.lit(False)


def label_is_supported(
    label: str,
    inclusion: Column,
    exclusion: Column,
    corpus: Mapping[str, Sequence[str]] = POPULATION_PHRASES,
    age_labels: Sequence[str] = AGE_LABELS,
) -> Column:
    """A label set to 1 must be named in the inclusion text or stay unnamed in the exclusion text.

    Age labels need an age phrase in the inclusion text as well. Rows without an inclusion text,
    and labels that are not 1, hold.
    """
    named = evidence_for(inclusion, label, corpus) | ~evidence_for(exclusion, label, corpus)
    if label in age_labels:
        phrases = corpus.get(label, ())
        named = named & (age_phrase(inclusion, phrases) if phrases else F.lit(False))
    applies = inclusion.isNotNull() & F.coalesce(F.col(label) == 1, F.lit(False))
    return ~applies | named


def row_is_supported(labels: Sequence[str], inclusion: Column, exclusion: Column, **options) -> Column:
    checks = [label_is_supported(a, inclusion, exclusion, **options) for a in labels]
    return reduce(lambda x, y: x & y, checks)


def contradicts(text: Column, keyword: str, label: Column) -> Column:
    """True where the text names the keyword although the label says 0."""
    return F.coalesce(text.rlike(f"(?i){keyword}") & (label == 0), F.lit(False))


def years(age: Column) -> Column:
    """``18 Years`` or ``6 Months`` as years; null where no age is given."""
    number = F.regexp_extract(age, r"(\d+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(age, r"\d+\s*([A-Za-z]+)", 1))
    per_year = (
        F.when(unit.startswith("month"), 12.0)
        .when(unit.startswith("week"), 52.0)
        .when(unit.startswith("day"), 365.0)
        .otherwise(1.0)
    )
    return number / per_year


def age_in_band(maximum: Column, minimum: Column, lower: float, upper: float) -> Column:
    """True where the age interval overlaps [lower, upper); a missing bound is open."""
    return (F.coalesce(minimum, F.lit(0.0)) < upper) & (F.coalesce(maximum, F.lit(1000.0)) >= lower)
