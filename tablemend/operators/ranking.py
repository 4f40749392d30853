"""Exact ranks without putting a whole group, or the whole table, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemend.session import cut_lineage

BUCKETS = 1 << 16


def exact_rank(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column | None = None,
    name: str = "rank",
) -> DataFrame:
    """Rank 1, 2, ... of each row within its group, as ``row_number`` over the group would give.

    Without ``bucket`` the rows are sorted over all groups at once: Spark samples where to cut, so a heavy group is
    cut into more slices than others whatever its keys are like, and a row's rank is its position less that of
    its group's first row.

    ``bucket`` spares the sort where the caller knows better: an integer that never falls along ``order`` and splits
    a group into slices. Rows are numbered within their slice, and each slice starts after the counted rows of the slices
    before it. Only the counts per slice meet in one task. Rows that tie on ``order`` are numbered
    arbitrarily, so ``order`` should be unique.
    """
    if bucket is None:
        placed = numbered(df, [*groups, *order], "_position").withColumn("_key", F.struct(F.lit(0).alias("_all"), *groups))
        starts = placed.groupBy("_key").agg((F.min("_position") - 1).alias("_start"))
        # As in `join_per_key`: a side aggregated by the join's own key would keep a hot group in one task.
        starts = starts.select(F.struct("_key").alias("_joined_key"), "_start")
        ranked = placed.withColumn("_joined_key", F.struct("_key")).join(starts, "_joined_key")
        return ranked.select(*df.columns, (F.col("_position") - F.col("_start")).alias(name))
    # One struct is the key of window and join: it keeps null groups, and rows shuffle once for both.
    sliced = df.withColumn("_key", F.struct(*groups, bucket.alias("_slice")))
    counts = sliced.groupBy("_key").agg(F.count("*").alias("_count"))
    group = F.struct(F.lit(0).alias("_all"), *[F.col(f"_key.{g}") for g in groups])
    before = Window.partitionBy(group).orderBy("_key._slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_key", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_key").orderBy(*order)
    ranked = sliced.withColumn("_local", F.row_number().over(inside)).join(starts, "_key")
    return ranked.select(*df.columns, (F.col("_start") + F.col("_local")).alias(name))


def hash_slice(*columns: str, buckets: int = BUCKETS) -> tuple[Column, Column]:
    """A pseudo-random order of rows, and slices that follow it: the top bits of one hash.

    Reading the hash as a signed number, its arithmetic shift never falls while the hash rises.
    """
    mixed = F.xxhash64(*columns)
    bits = buckets.bit_length() - 1
    return mixed, F.shiftright(mixed, 64 - bits).cast("int")


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Rows with their position 0, 1, ... in a global order.

    The sorted rows are written once to the shared folder: sorting again could cut partitions
    elsewhere. A row's position is its place in its partition plus the sizes of those before.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the sort: as many as the session's shuffle partitions at most.
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.select(*df.columns, (F.col("_start") + place).alias(name))


def best_threshold(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], threshold: str) -> DataFrame:
    """The threshold with the highest value of each metric; the larger threshold wins ties."""
    picks = [
        F.max_by(threshold, F.struct(F.coalesce(F.col(m), F.lit(0.0)), F.col(threshold))).alias(f"best_{m}")
        for m in metrics
    ]
    return df.groupBy(*keys).agg(*picks)


def at_threshold(df: DataFrame, threshold: str, chosen: Column | str) -> DataFrame:
    """The rows of a sweep at the learned threshold, compared in hundredths."""
    wanted = F.col(chosen) if isinstance(chosen, str) else chosen
    return df.filter(F.round(F.col(threshold) * 100).cast("int") == F.round(wanted * 100).cast("int"))


def best_by(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The best-scoring row of each key; ties go to the smallest ``ties`` columns."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct((-F.col(score)).alias("worst"), *ties)
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def confidence(probability: Column) -> Column:
    return F.array_max(probability)


def predicted_class(probability: Column) -> Column:
    """Position of the largest class probability, from 0; the first one wins ties."""
    return (F.array_position(probability, F.array_max(probability)) - 1).cast("int")
