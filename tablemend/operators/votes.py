"""Gold standards: majority vote within a registry, agreement across registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemend.functions.evidence import age_in_band, years
from tablemend.functions.text import equals_ignoring_case
from tablemend.operators.joins import agreement
from tablemend.spec import AGE_BANDS


def majority_vote(df: DataFrame, key: str, attrs: Sequence[str], complete: bool = False) -> DataFrame:
    """Per entity and 0/1 attribute: the more frequent value, null on a tie, with both counts.

    All attributes come from one grouping. ``complete`` keeps only entities that cast at least
    one vote on every attribute. Columns: key, a, a_yes, a_no for each attribute.
    """
    counters = []
    for a in attrs:
        counters += [F.count_if(F.col(a) == 1).alias(f"{a}_yes"), F.count_if(F.col(a) == 0).alias(f"{a}_no")]
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*counters)
    if complete:
        for a in attrs:
            counts = counts.filter(F.col(f"{a}_yes") + F.col(f"{a}_no") > 0)
    cells = []
    for a in attrs:
        yes, no = F.col(f"{a}_yes"), F.col(f"{a}_no")
        cells += [F.when(yes > no, 1).when(yes < no, 0).alias(a), yes, no]
    return counts.select(key, *cells)


def decided(votes: DataFrame, key: str, attrs: Sequence[str]) -> DataFrame:
    """Entities whose vote is decided on every attribute."""
    return votes.select(key, *attrs).dropna()


def consensus(
    votes: DataFrame,
    described: DataFrame,
    second: DataFrame,
    third: DataFrame,
    key: str,
    attrs: Sequence[str],
    third_attrs: Sequence[str],
) -> DataFrame:
    """Decided entities that have a description and agree with both other registries."""
    gold = decided(votes, key, attrs).join(described.select(key).distinct(), key, "left_semi")
    gold = agreement(gold, second, key, attrs)
    return agreement(gold, third, key, third_attrs)


def population_from_registry(
    trials: DataFrame,
    key: str,
    gender: str,
    minimum_age: str,
    maximum_age: str,
    everybody: str = "all",
    volunteers: str | None = None,
    accepting: str = "Accepts Healthy Volunteers",
) -> DataFrame:
    """The 0/1 population attributes that a registry states as gender, age range and acceptance.

    ``female`` holds for everybody and whenever the gender text contains that word.
    """
    sex = F.col(gender)
    everyone = F.coalesce(equals_ignoring_case(sex, everybody), F.lit(False))
    male = everyone | F.coalesce(equals_ignoring_case(sex, "male"), F.lit(False))
    female = everyone | F.coalesce(F.lower(sex).contains("female"), F.lit(False))
    low, high = years(F.col(minimum_age)), years(F.col(maximum_age))
    columns = [male.cast("int").alias("male"), female.cast("int").alias("female"), everyone.cast("int").alias("others")]
    columns += [age_in_band(high, low, *band).cast("int").alias(label) for label, band in AGE_BANDS.items()]
    if volunteers:
        accepts = F.coalesce(F.col(volunteers) == accepting, F.lit(False))
        columns.append(accepts.cast("int").alias("healthy_volunteers"))
    return trials.filter(F.col(key).isNotNull()).select(key, *columns).distinct()
