"""Selection of rows to learn from: duplicates, constraints, splits and over-sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.operators.aggregates import class_lookup, without_conflicts
from tablemend.operators.filters import drop_null_rows, keep_texts, satisfying_about
from tablemend.operators.joins import last_per_key, with_entities, without_entities
from tablemend.operators.ranking import exact_rank
from tablemend.spec import IMBALANCE_LIMIT, EditRule, RepairSpec


def last_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the last in ``order``.

    Copies combine on the map side, so a text that fills a third of the table is no hot task.
    """
    return last_per_key(df, keys, order)


def training_table(df: DataFrame, gold: DataFrame, spec: RepairSpec, order: Sequence[str | Column]) -> DataFrame:
    """The table to learn from: complete rows with a text, no duplicates, no gold entities."""
    rows = keep_texts(drop_null_rows(df, [spec.text, *spec.labels]), spec.text)
    rows = without_entities(rows, gold, spec.partial_key)
    return last_duplicates(rows, [*spec.full_key, spec.text], order)


def test_table(df: DataFrame, gold: DataFrame, spec: RepairSpec) -> DataFrame:
    return with_entities(df, gold, spec.partial_key)


def clean_for(
    df: DataFrame, key: str, text: str, label: str, rules: Sequence[EditRule] = ()
) -> DataFrame:
    """Rows fit to learn ``label``: complete, no broken rule about it, no conflict within the entity."""
    rows = satisfying_about(drop_null_rows(df, [key, text, label]), rules, label)
    return without_conflicts(rows, key, label)


def _per_class(df: DataFrame, per_class: DataFrame, label: str, value: str, classes: Sequence | None) -> DataFrame:
    """``df`` with the ``value`` of each row's class: looked up for known classes, joined for others."""
    if classes is not None:
        return df.withColumn(value, class_lookup(per_class, label, value, classes))
    renamed = per_class.select(F.col(label).alias("_label"), value)
    return df.join(renamed, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def split_train_valid(
    df: DataFrame, label: str, order: Column, tie: str, percent: int = 10, classes: Sequence | None = None
) -> DataFrame:
    """Every row with ``part`` = train / valid, both holding all classes that have two rows.

    ``order`` is a pseudo-random integer in 0..99 per row; a row is valid below ``percent``. Of each
    class the row first in (order, tie) is always valid and the last one always train. First and
    last rows are aggregates, so a class that holds most rows is not gathered anywhere.
    """
    spot = F.struct(order.alias("order"), F.col(tie).alias("tie"))
    edges = df.groupBy(label).agg(F.struct(F.min(spot).alias("first"), F.max(spot).alias("last")).alias("_edges"))
    first, last = F.col("_edges.first"), F.col("_edges.last")
    part = (
        F.when(first == last, "train")
        .when(spot == first, "valid")
        .when(spot == last, "train")
        .when(order < percent, "valid")
        .otherwise("train")
    )
    return _per_class(df, edges, label, "_edges", classes).select(*df.columns, part.alias("part"))


def oversample(
    df: DataFrame,
    label: str,
    order: Sequence[str | Column],
    bucket: Column | None = None,
    limit: float = IMBALANCE_LIMIT,
    classes: Sequence | None = None,
) -> DataFrame:
    """Rows of smaller classes repeated until each class is as large as the largest one.

    Nothing is repeated when smallest / largest >= ``limit``. The rows to repeat once more than the
    rest are the first in ``order``; see `exact_rank` for ``bucket``. Adds ``copy`` (0 = the row itself).
    """
    counts = df.groupBy(label).agg(F.count("*").alias("rows"))
    sizes = counts.agg(F.struct(F.min("rows").alias("least"), F.max("rows").alias("most")).alias("sizes")).scalar()
    least, most = F.col("_sizes.least"), F.col("_sizes.most")
    goal = F.when(least / most < limit, most).otherwise(F.col("rows"))
    goals = counts.withColumn("_sizes", sizes).select(label, F.struct("rows", goal.alias("goal")).alias("_goal"))
    ranked = _per_class(exact_rank(df, [label], order, bucket, "_rank"), goals, label, "_goal", classes)
    rows, goal = F.col("_goal.rows"), F.col("_goal.goal")
    whole_copies = F.floor(goal / rows).cast("int")
    extra = (F.col("_rank") <= goal % rows).cast("int")
    copies = F.sequence(F.lit(0), whole_copies + extra - 1)
    return ranked.select(*df.columns, F.explode(copies).alias("copy"))
