"""Evaluation against a gold standard: cell counts, quality measures, sweeps and source prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemend.functions.numbers import ratio, round_share
from tablemend.operators.aggregates import unfolded
from tablemend.operators.joins import attach_gold, first_per_key, join_per_key, with_entities
from tablemend.operators.repair import gated
from tablemend.spec import CONFIDENCE_SCALE


@dataclass(frozen=True)
class Cells:
    """Where a table keeps the original, gold and repaired cell of an attribute."""

    original: str = "{}"
    gold: str = "{}_gs"
    repaired: str = "{}_rep"

    def of(self, attr: str) -> tuple[Column, Column, Column]:
        return tuple(F.col(p.format(attr)) for p in (self.original, self.gold, self.repaired))


def differs(left: Column, right: Column) -> Column:
    """Null-safe inequality: two missing values are equal."""
    return ~left.eqNullSafe(right)


def _counters(original: Column, gold: Column, repaired: Column) -> tuple[Column, Column, Column]:
    repair = differs(original, repaired)
    return differs(original, gold), repair, repair & repaired.eqNullSafe(gold)


def cell_counts(df: DataFrame, attrs: Sequence[str], cells: Cells = Cells(), keys: Sequence[str] = ()) -> DataFrame:
    """Errors, repairs and correct repairs per attribute (and per ``keys``): one pass, no unfolding of rows."""
    aggregates = []
    for a in attrs:
        for name, test in zip(("errors", "repairs", "correct"), _counters(*cells.of(a))):
            aggregates.append(F.count_if(test).alias(f"{name}_{a}"))
    wide = df.groupBy(*keys).agg(*aggregates)
    return unfolded(wide, list(keys), attrs, errors="errors_{}", repairs="repairs_{}", correct="correct_{}")


def totals(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts summed over the attributes."""
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("errors", "repairs", "correct")])


def with_total(counts: DataFrame) -> DataFrame:
    """The attributes' rows and one row ``*`` for all of them."""
    sums = counts.rollup("attr").agg(*[F.sum(c).alias(c) for c in ("errors", "repairs", "correct")])
    return sums.withColumn("attr", F.coalesce("attr", F.lit("*")))


def with_quality(counts: DataFrame, rounded: bool = False) -> DataFrame:
    """Precision, recall and F1; ``rounded`` takes F1 from the two rounded values and rounds it."""
    precision, recall = ratio(F.col("correct"), F.col("repairs")), ratio(F.col("correct"), F.col("errors"))
    if rounded:
        precision, recall = round_share(precision), round_share(recall)
    out = counts.withColumn("precision", precision).withColumn("recall", recall)
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * (p * r) / (p + r))
    return out.withColumn("f1", round_share(f1) if rounded else f1)


def evaluate_repairs(
    original: DataFrame,
    repairs: Mapping[str, DataFrame],
    gold: DataFrame,
    key: str,
    source: str,
    attrs: Sequence[str],
) -> DataFrame:
    """Cell counts of several repairs of one table, per strategy and attribute.

    A row counts for a strategy if exactly one of its repaired rows has the full key; the gold row of
    an entity stands for all its sources. Original and gold rows are matched once for all strategies,
    and everything is counted in one aggregate.
    """
    sides = None
    counters = []
    for i, repaired in enumerate(repairs.values()):
        cells = F.struct(*[F.col(a).alias(f"{a}_{i}") for a in attrs])
        side = with_entities(repaired, gold, key).groupBy(key, source).agg(
            F.count("*").alias(f"_n{i}"), F.any_value(cells).alias(f"_row{i}")
        )
        sides = side if sides is None else sides.join(side, [key, source], "full")
        once = F.coalesce(F.col(f"_n{i}") == 1, F.lit(False))
        for a in attrs:
            tests = _counters(F.col(a), F.col(f"{a}_gs"), F.col(f"_row{i}.{a}_{i}"))
            for name, test in zip(("errors", "repairs", "correct"), tests):
                counters.append(F.count_if(once & test).alias(f"{name}_{i}_{a}"))
    # Repairs and gold have one row per key and meet first; the original rows take part in one join.
    single = first_per_key(gold.select(key, *attrs), [key], attrs)
    sides = attach_gold(sides, single, key, attrs)
    rows = join_per_key(original.select(key, source, *attrs), sides, [key, source], "inner")
    out = [
        F.struct(
            F.lit(strategy).alias("strategy"),
            F.lit(a).alias("attr"),
            *[F.col(f"{name}_{i}_{a}").alias(name) for name in ("errors", "repairs", "correct")],
        )
        for i, strategy in enumerate(repairs)
        for a in attrs
    ]
    return rows.agg(*counters).select(F.inline(F.array(*out)))


def evaluate_repair(
    original: DataFrame, repaired: DataFrame, gold: DataFrame, key: str, source: str, attrs: Sequence[str]
) -> DataFrame:
    """Cell counts of one repair over the rows whose full key matches once."""
    return evaluate_repairs(original, {"": repaired}, gold, key, source, attrs).drop("strategy")


def outside_cells(tables: Mapping[str, DataFrame], keys: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """Repaired tables of other cleaners as one row per full key: ``_n_<name>`` rows and the cells ``_row_<name>``.

    The tables are stacked and grouped once, whatever their number. A cell goes by its own table's type.
    """
    names = list(tables)
    stacked = None
    for name, rows in tables.items():
        cells = F.struct(*[F.col(a).alias(a) for a in attrs])
        nothing = [F.lit(None).cast(tables[n].select(*attrs).schema.simpleString()) for n in names]
        own = [cells if n == name else empty for n, empty in zip(names, nothing)]
        side = rows.select(*keys, *[c.alias(f"_row_{n}") for n, c in zip(names, own)])
        stacked = side if stacked is None else stacked.unionByName(side)
    counters = [F.count(f"_row_{n}").alias(f"_n_{n}") for n in names]
    picks = [F.any_value(f"_row_{n}", ignoreNulls=True).alias(f"_row_{n}") for n in names]
    return stacked.dropna(subset=list(keys)).groupBy(*keys).agg(*counters, *picks)


def compare_columns(
    df: DataFrame,
    strategies: Mapping[str, Mapping[str, Column]],
    attrs: Sequence[str],
    counted: Mapping[str, Column] | None = None,
    cells: Cells = Cells(),
) -> DataFrame:
    """The strategy table where all strategies' cells stand beside the original and gold ones: one aggregate, no join.

    ``strategies``: the repaired cell of each attribute, by strategy. ``counted``: which rows count for a strategy (all,
    if not named).
    """
    counters, out = [], []
    for i, (strategy, repaired) in enumerate(strategies.items()):
        inside = F.coalesce((counted or {}).get(strategy, F.lit(True)), F.lit(False))
        for j, a in enumerate(attrs):
            original, gold, _ = cells.of(a)
            named = [F.lit(strategy).alias("strategy"), F.lit(a).alias("attr")]
            for name, test in zip(("errors", "repairs", "correct"), _counters(original, gold, repaired[a])):
                counters.append(F.count_if(inside & test).alias(f"{name}_{i}_{j}"))
                named.append(F.col(f"{name}_{i}_{j}").alias(name))
            out.append(F.struct(*named))
    counts = df.agg(*counters).select(F.explode(F.array(*out, *_sums(out, len(attrs)))).alias("c")).select("c.*")
    return with_quality(counts)


def _sums(cells: Sequence[Column], n_attrs: int) -> list[Column]:
    """For each strategy the sums over its attributes, as attribute ``*``."""
    out = []
    for i in range(0, len(cells), n_attrs):
        own = cells[i : i + n_attrs]
        sums = [reduce(lambda x, y: x + y, [c[name] for c in own]).alias(name) for name in ("errors", "repairs", "correct")]
        out.append(F.struct(own[0]["strategy"].alias("strategy"), F.lit("*").alias("attr"), *sums))
    return out


def compare_strategies(
    original: DataFrame,
    repairs: Mapping[str, DataFrame],
    gold: DataFrame,
    key: str,
    source: str,
    attrs: Sequence[str],
) -> DataFrame:
    """One row per strategy and attribute, and per strategy in total (``*``)."""
    counts = evaluate_repairs(original, repairs, gold, key, source, attrs)
    return with_quality(counts.unionByName(totals(counts, ["strategy"]).withColumn("attr", F.lit("*"))))


def errors_by_class(df: DataFrame, attrs: Sequence[str], cells: Cells = Cells()) -> DataFrame:
    """Erroneous cells per attribute and gold value."""
    wide = unfolded(df, [], attrs, original=cells.original, gold=cells.gold)
    return wide.groupBy("attr", "gold").agg(F.count_if(differs(F.col("original"), F.col("gold"))).alias("errors"))


def error_ratios(df: DataFrame, attrs: Sequence[str], cells: Cells = Cells()) -> DataFrame:
    """Errors and repairs per attribute as shares of all rows."""
    counters = [F.count("*").alias("n_rows")]
    for a in attrs:
        error, repair, _ = _counters(*cells.of(a))
        counters += [F.count_if(error).alias(f"errors_{a}"), F.count_if(repair).alias(f"repairs_{a}")]
    wide = df.agg(*counters)
    rows = unfolded(wide, ["n_rows"], attrs, errors="errors_{}", repairs="repairs_{}")
    return rows.select(
        "attr",
        "n_rows",
        ratio(F.col("errors"), F.col("n_rows")).alias("error_ratio"),
        ratio(F.col("repairs"), F.col("n_rows")).alias("repair_ratio"),
    )


def average_error_rate(ratios: DataFrame) -> DataFrame:
    return ratios.agg(F.avg("error_ratio").alias("avg_error_rate"))


def confidence_threshold(
    df: DataFrame, gold: str, predicted: str, confidence: str, scale: float = CONFIDENCE_SCALE
) -> DataFrame:
    """Scaled mean, over the gold classes, of the mean confidence of right predictions (0 if there is none)."""
    right = F.when(F.col(gold) == F.col(predicted), F.col(confidence))
    per_class = df.filter(F.col(gold).isNotNull()).groupBy(gold).agg(F.coalesce(F.avg(right), F.lit(0.0)).alias("m"))
    return per_class.agg((F.avg("m") * scale).alias("tau"))


def sweep_thresholds(tau: float | None, steps: Sequence[float] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)) -> list[float]:
    return sorted({0.0, *steps, *([] if tau is None else [round(tau, 2)])})


def threshold_sweep(
    df: DataFrame,
    attrs: Sequence[str],
    thresholds: Mapping[str, Sequence[float]] | Sequence[float],
    original: str = "{}",
    gold: str = "{}_gs",
    predicted: str = "{}_pred",
    confidence: str = "{}_conf",
) -> DataFrame:
    """Cell counts of the gated repair at every threshold, from one pass over the rows.

    A row is not repeated per threshold: it is counted at the highest threshold it passes, and the
    small table of counts is summed from the top.
    """
    parts = []
    for a in attrs:
        steps = sorted(set(thresholds[a] if isinstance(thresholds, Mapping) else thresholds))
        original_, gold_, predicted_, confidence_ = (F.col(p.format(a)) for p in (original, gold, predicted, confidence))
        passed = reduce(lambda x, y: x + y, [(confidence_ >= F.lit(t)).cast("int") for t in steps])
        level = F.when(original_.isNull(), len(steps)).otherwise(F.coalesce(passed, F.lit(0)))
        parts.append((a, steps, level, _counters(original_, gold_, predicted_)))
    cells = [
        F.struct(
            F.lit(a).alias("attr"), level.alias("level"), e.alias("error"), r.alias("repair"), c.alias("right")
        )
        for a, _, level, (e, r, c) in parts
    ]
    counts = (
        df.select(F.inline(F.array(*cells)))
        .groupBy("attr", "level")
        .agg(
            F.count_if("error").alias("errors"), F.count_if("repair").alias("repairs"), F.count_if("right").alias("correct")
        )
    )
    grid = [F.struct(F.lit(a).alias("attr"), F.lit(i).alias("level"), F.lit(t).alias("threshold"))
            for a, steps, _, _ in parts for i, t in enumerate(steps, start=1)]
    per_attr = counts.groupBy("attr").agg(
        F.collect_list(F.struct("level", "repairs", "correct")).alias("levels"), F.sum("errors").alias("errors")
    )
    # At most one entry per threshold and attribute is in ``levels``.
    steps_of = F.filter(F.array(*grid), lambda g: g["attr"] == F.col("attr"))

    def above(field: str) -> Column:
        reached = F.filter("levels", lambda x: x["level"] >= F.col("step.level"))
        return F.aggregate(reached, F.lit(0).cast("bigint"), lambda total, x: total + x[field])

    rows = per_attr.select("attr", "levels", "errors", F.explode(steps_of).alias("step"))
    return rows.select(
        "attr",
        F.col("step.threshold").alias("threshold"),
        "errors",
        above("repairs").alias("repairs"),
        above("correct").alias("correct"),
    )


def gate_counts(df: DataFrame, attr: str, tau: float, predicted: str, confidence: str, gold: str) -> DataFrame:
    """Cell counts of one gated attribute at one threshold."""
    final = gated(F.col(attr), F.col(predicted), F.col(confidence), tau)
    error, repair, right = _counters(F.col(attr), F.col(gold), final)
    return df.agg(
        F.count_if(error).alias("errors"), F.count_if(repair).alias("repairs"), F.count_if(right).alias("correct")
    )


# --- source prefixes ------------------------------------------------------------------------


def source_ranks(df: DataFrame, source: str) -> DataFrame:
    """Sources by falling row count, then by name. The window sees one row per source."""
    counts = df.groupBy(source).agg(F.count("*").alias("n_rows"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n_rows"), F.col(source))
    return counts.withColumn("source_rank", F.row_number().over(order))


def source_prefixes(df: DataFrame, source: str, attrs: Sequence[str], cells: Cells = Cells()) -> DataFrame:
    """Counts over the first s sources and the first n attributes, for every s and n.

    The rows are read once and counted per (source, attribute); two running sums over that small
    table replace a new repair per prefix.
    """
    counted = []
    for a in attrs:
        for name, test in zip(("errors", "repairs", "correct"), _counters(*cells.of(a))):
            counted.append(F.count_if(test).alias(f"{name}_{a}"))
    wide = df.groupBy(source).agg(F.count("*").alias("n_rows"), *counted)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n_rows"), F.col(source))
    wide = wide.withColumn("source_rank", F.row_number().over(order))
    upto = Window.partitionBy(F.lit(0)).orderBy("source_rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = []
    for n in range(1, len(attrs) + 1):
        sums = [
            F.sum(reduce(lambda x, y: x + y, [F.col(f"{m}_{a}") for a in attrs[:n]])).over(upto).alias(f"{m}__{n}")
            for m in ("errors", "repairs", "correct")
        ]
        wide = wide.select("*", *sums)
        rows.append(
            F.struct(
                F.lit(n).alias("n_attrs"),
                *[F.col(f"{m}__{n}").alias(m) for m in ("errors", "repairs", "correct")],
            )
        )
    return wide.select("source_rank", F.inline(F.array(*rows)))


def cumulative(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Running total along ``order``, such as training time over the attributes."""
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(upto))
