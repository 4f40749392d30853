"""Joins on entity keys, gold expansion and the strict three-way match.

Sides with one row per key are built by aggregates with map-side combine, so a hot key costs one
row per task there. The other side is left for adaptive execution to broadcast (by measured size)
or to split where a key is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.operators.ranking import numbered


def join_per_key(rows: DataFrame, single: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` joined to a table with one row per key, also where one key has most of the rows.

    Adaptive execution splits a hot partition of a join only if both sides come straight from their
    shuffle. A table aggregated by the key would skip that shuffle, so the join is on the keys as one
    struct: the small side is shuffled once more, and a hot key's rows spread over tasks. Null keys
    match nothing.
    """
    keys = list(keys)
    right = single.dropna(subset=keys).withColumn("_joined_key", F.struct(*keys)).drop(*keys)
    return rows.withColumn("_joined_key", F.struct(*keys)).join(right, "_joined_key", how).drop("_joined_key")


def without_entities(df: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Rows whose entity is not in the gold standard."""
    return join_per_key(df, gold.select(key).distinct(), [key], "left_anti")


def with_entities(df: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Rows whose entity is in the gold standard."""
    return join_per_key(df, gold.select(key).distinct(), [key], "left_semi")


def attach_gold(df: DataFrame, gold: DataFrame, key: str, labels: Sequence[str], suffix: str = "_gs") -> DataFrame:
    renamed = gold.select(key, *[F.col(a).alias(a + suffix) for a in labels])
    return join_per_key(df, renamed, [key], "inner")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key. An aggregate, not a window: hot keys combine before the shuffle."""
    return _pick(df, keys, F.min_by, order)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return _pick(df, keys, F.max_by, order)


def _pick(df: DataFrame, keys: Sequence[str], pick, order: Sequence[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def expand_gold(
    pairs: DataFrame, gold: DataFrame, key: str, source: str, order: Sequence[Column | str] | None = None
) -> DataFrame:
    """The gold row of each entity, once for every source row seen for it in ``pairs``."""
    single = first_per_key(gold, [key], order or [c for c in gold.columns if c != key])
    return join_per_key(pairs.select(key, source), single.drop(source), [key], "inner")


def match_three(
    original: DataFrame,
    gold: DataFrame,
    repaired: DataFrame,
    key: Sequence[str],
    attrs: Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """Original rows with their gold and repaired cells and a ``match_status``.

    ``ok``: exactly one gold and one repaired row share the full key. ``multiple``: more than one
    on either side. ``none``: no row on a side; with ``strict`` such a row fails the job.
    Columns: key, a, a_gs, a_rep for each attribute, match_status.
    """

    def side(df: DataFrame, suffix: str) -> DataFrame:
        # Cell by cell: numbers are then grouped by hash, where a struct would have every row sorted. All are of the same row.
        picks = [F.any_value(a).alias(f"_cell_{i}{suffix}") for i, a in enumerate(attrs)]
        return df.groupBy(*key).agg(F.count("*").alias("_n" + suffix), *picks)

    # The two one-row-per-key sides meet first: the original rows then take part in one join only,
    # which adaptive execution can split where a key is hot.
    sides = side(gold, "_gs").join(side(repaired, "_rep"), list(key), "full")
    joined = join_per_key(original.select(*key, *attrs), sides, key)
    n_gold, n_rep = F.col("_n_gs"), F.col("_n_rep")
    missing = n_gold.isNull() | n_rep.isNull()
    status = (
        F.when(n_gold.isNull(), "none")
        .when(n_gold > 1, "multiple")
        .when(n_rep.isNull(), "none")
        .when(n_rep > 1, "multiple")
        .otherwise("ok")
    )
    if strict:
        failure = F.raise_error(F.concat(F.lit("no match for key "), F.to_json(F.struct(*key))))
        status = F.when((status == "none") & missing, failure.cast("string")).otherwise(status)
    cells = [F.col(a) for a in attrs]
    cells += [F.col(f"_cell_{i}{suffix}").alias(a + suffix) for suffix in ("_gs", "_rep") for i, a in enumerate(attrs)]
    return joined.select(*key, *cells, status.alias("match_status"))


def match_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("match_status").agg(F.count("*").alias("n_rows"))


def agreement(left: DataFrame, right: DataFrame, key: str, attrs: Sequence[str]) -> DataFrame:
    """Left rows for which some right row has the same key and the same values; nulls agree with nothing."""
    return left.join(right.select(key, *attrs).distinct(), [key, *attrs], "left_semi")


def merge_entities(base: DataFrame, gold: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """Rows of ``base`` with an entity in ``gold``; the gold values overwrite columns of the same name."""
    single = first_per_key(gold, [key], order)
    kept = [c for c in base.columns if c == key or c not in gold.columns]
    return join_per_key(base.select(*kept), single, [key], "inner")


def overlap_counts(df: DataFrame, gold: DataFrame, key: str, attrs: Sequence[str], n_fds: int = 1) -> DataFrame:
    """Rows, rows with a gold entity, evaluated attributes and functional dependencies."""
    known = gold.select(key).distinct().withColumn("_known", F.lit(1))
    return join_per_key(df.select(key), known, [key]).agg(
        F.count("*").alias("n_rows"),
        F.count("_known").alias("n_overlap"),
        F.lit(len(attrs)).alias("n_attrs"),
        F.lit(n_fds).alias("n_fds"),
    )


def append_columns(
    left: DataFrame, right: DataFrame, left_order: Sequence[Column | str], right_order: Sequence[Column | str]
) -> DataFrame:
    """Row i of ``right`` beside row i of ``left``, both in an explicit order; the longer side keeps nulls."""
    rows = numbered(left, left_order, "_position")
    return rows.join(numbered(right, right_order, "_position"), "_position", "full").drop("_position")
