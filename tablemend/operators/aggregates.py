"""Class statistics, conflicts within entities, value counts and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemend.functions.numbers import half_even
from tablemend.operators.joins import join_per_key


def unfolded(df: DataFrame, keys: Sequence[str], attrs: Sequence[str], **cells: str) -> DataFrame:
    """One row per (row, attribute): ``attr`` and a column per named cell pattern, e.g. ``value="{}"``.

    The rows are meant for an aggregate that follows at once; they are never shuffled as they are.
    """
    rows = [
        F.struct(F.lit(a).alias("attr"), *[F.col(p.format(a)).alias(n) for n, p in cells.items()]) for a in attrs
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n_rows"))


def class_stats(df: DataFrame, label: str) -> DataFrame:
    """One row: classes, smallest and largest class, and their ratio rounded to three decimals."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("n_class"),
        F.min("n").alias("min_count"),
        F.max("n").alias("max_count"),
        half_even(F.min("n") / F.max("n"), 3).alias("ir"),
    )


def class_shares(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows and share of each class of each attribute."""
    counts = (
        unfolded(df, [], labels, value="{}")
        .filter(F.col("value").isNotNull())
        .groupBy("attr", "value")
        .agg(F.count("*").alias("n_rows"))
    )
    total = F.sum("n_rows").over(Window.partitionBy("attr"))
    return counts.withColumn("share", F.col("n_rows") / total)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (rows of the class * classes)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    rows, classes = F.sum("n").over(everything), F.count("*").over(everything)
    return counts.select(label, F.col("n").alias("n_rows"), (rows / (F.col("n") * classes)).alias("weight"))


def class_lookup(per_class: DataFrame, label: str, value: str, classes: Sequence) -> Column:
    """What a table of one row per class holds for a row's class, as a one-row subquery.

    The known classes bound the subquery, and the rows that look something up stay where they are.
    """
    picks = [F.max(F.when(F.col(label) == F.lit(c), F.col(value))) for c in classes]
    at = F.coalesce(*[F.when(F.col(label) == F.lit(c), F.lit(i)) for i, c in enumerate(classes)])
    return F.get(per_class.agg(F.array(*picks).alias("values")).scalar(), at)


def with_sample_weights(df: DataFrame, label: str, name: str = "weight", domain: Sequence | None = None) -> DataFrame:
    """Each row with the weight of its class.

    With a known domain the weights are looked up. Otherwise they are joined, which adaptive execution
    broadcasts or splits by measured size.
    """
    weights = class_weights(df, label)
    if domain is None:
        return join_per_key(df, weights.select(label, F.col("weight").alias(name)), [label]).select(*df.columns, name)
    return df.withColumn(name, class_lookup(weights, label, "weight", domain))


def conflicts(df: DataFrame, key: str, attr: str) -> DataFrame:
    """Entities with more than one distinct non-null value of ``attr``. A null key is no entity.

    Smallest and largest value differ: two mergeable buffers per entity instead of a distinct count.
    """
    return df.dropna(subset=[key]).groupBy(key).agg(F.min(attr).alias("low"), F.max(attr).alias("high")).filter("low <> high").select(key)


def conflict_counts(df: DataFrame, key: str, attrs: Sequence[str]) -> DataFrame:
    """Conflicting entities per attribute, all attributes from one grouping."""
    spread = df.dropna(subset=[key]).groupBy(key).agg(*[(F.min(a) != F.max(a)).alias(a) for a in attrs])
    counts = spread.agg(*[F.count_if(a).alias(a) for a in attrs])
    return unfolded(counts, [], attrs, n_conflicts="{}")


def distinct_values(df: DataFrame, key: str, attrs: Sequence[str]) -> DataFrame:
    """Number of distinct non-null values of each attribute in every entity."""
    return df.dropna(subset=[key]).groupBy(key).agg(*[F.count_distinct(a).alias(f"n_{a}") for a in attrs])


def without_conflicts(df: DataFrame, key: str, attr: str) -> DataFrame:
    """Rows of entities that agree on ``attr``."""
    return join_per_key(df, conflicts(df, key, attr), [key], "left_anti")


def distinct_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.count_distinct(*columns).alias("n_distinct"))


def sources_per_key(df: DataFrame, key: str, source: str) -> DataFrame:
    """The sorted distinct sources of each entity; as long as there are sources, not rows. A null key is no entity."""
    return df.dropna(subset=[key]).groupBy(key).agg(F.array_sort(F.collect_set(source)).alias("sources"))


def accuracy(predicted: Column, gold: Column) -> Column:
    """Aggregate: share of rows predicted right; null where there are no rows."""
    return F.try_divide(F.count_if(predicted == gold), F.count("*"))


def correlations(df: DataFrame, feature: str, labels: Sequence[str]) -> DataFrame:
    """Pearson correlation of a numeric text feature with each attribute."""
    row = df.agg(*[F.corr(F.col(feature).cast("double"), F.col(a).cast("double")).alias(a) for a in labels])
    return unfolded(row, [], labels, correlation="{}")
