"""Mining of edit rules from value pairs, and detection of outlying rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType, StructType

from tablemend.session import cut_lineage
from tablemend.spec import EditRule, Implication


def _counts(df: DataFrame, attrs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Counts of value pairs (attr1 before attr2 in ``attrs``), and of values, from one pass; nulls are ignored.

    Pairs are counted as they are, whatever else a row holds: the work grows with rows and pairs of attributes, not with the
    number of different rows. Counts are added up before they are shuffled.
    """

    def cell(a: str, b: str | None):
        other = [F.lit(b), F.col(b).cast("string")] if b else [F.lit(None).cast("string")] * 2
        names = ("attr1", "value1", "attr2", "value2")
        return F.struct(*[c.alias(n) for c, n in zip([F.lit(a), F.col(a).cast("string"), *other], names)])

    cells = [cell(a, b) for a, b in [*combinations(attrs, 2), *[(a, None) for a in attrs]]]
    rows = df.select(F.inline(F.array(*cells))).where("value1 IS NOT NULL AND (attr2 IS NULL OR value2 IS NOT NULL)")
    # Both results read these few rows.
    counts = cut_lineage(rows.groupBy("attr1", "value1", "attr2", "value2").agg(F.count("*").alias("n")))
    singles = counts.where("attr2 IS NULL").select(F.col("attr1").alias("attr"), F.col("value1").alias("value"), F.col("n").alias("n_value"))
    return counts.where("attr2 IS NOT NULL").withColumnRenamed("n", "n_pair"), singles


def _both_ways(pairs: DataFrame) -> DataFrame:
    turned = pairs.select(F.col("attr2").alias("attr1"), F.col("value2").alias("value1"), F.col("attr1").alias("attr2"), F.col("value1").alias("value2"), "n_pair")
    return pairs.unionByName(turned)


def _single(singles: DataFrame, i: int) -> DataFrame:
    return singles.select(
        F.col("attr").alias(f"attr{i}"), F.col("value").alias(f"value{i}"), F.col("n_value").alias(f"n_value{i}")
    )


def _strong(df: DataFrame, pairs: DataFrame, singles: DataFrame, support: float, confidence: float, sigma: float) -> DataFrame:
    rated = pairs.join(_single(singles, 1), ["attr1", "value1"]).join(_single(singles, 2), ["attr2", "value2"])
    rated = rated.withColumn("n_rows", df.agg(F.count("*")).scalar())
    return rated.filter(
        (F.col("n_pair") / F.col("n_rows") >= support)
        & (F.col("n_pair") / F.col("n_value1") >= confidence)
        & (F.col("n_pair") * F.col("n_rows") / (F.col("n_value1") * F.col("n_value2")) >= sigma)
    )


def implications(df: DataFrame, attrs: Sequence[str], support: float = 0.3, confidence: float = 0.98, sigma: float = 0.9) -> DataFrame:
    """Strong implications ``attr1 = value1 -> attr2 = value2`` with their support, confidence and lift: one row each.

    As rules (`as_implications`) they are checked, counted and repaired directly; the values that they rule out are never listed.
    """
    pairs, singles = _counts(df, attrs)
    n, total = F.col("n_pair"), F.col("n_rows")
    return _strong(df, _both_ways(pairs), singles, support, confidence, sigma).select(
        "attr1", "value1", "attr2", "value2", "n_pair",
        (n / total).alias("support"), (n / F.col("n_value1")).alias("confidence"), (n * total / (F.col("n_value1") * F.col("n_value2"))).alias("lift"),
    )


def association_rules(
    df: DataFrame,
    attrs: Sequence[str],
    support: float = 0.3,
    confidence: float = 0.98,
    epsilon: float = 0.9,
    sigma: float = 0.9,
) -> DataFrame:
    """Forbidden pairs from strong implications ``attr1 = value1 -> attr2 = w``.

    An implication needs the support, the confidence, and a lift of at least ``sigma``. It forbids
    every other seen value of attr2 beside value1, provided the pair is at least ``epsilon`` rarer than
    independence would make it, so that rare values are not pushed out by frequent ones. The list has a row per other value; for attributes
    with many values take `implications`.
    """
    pairs, singles = _counts(df, attrs)
    pairs = _both_ways(pairs)
    strong = _strong(df, pairs, singles, support, confidence, sigma).select(
        "attr1", "value1", "n_value1", "n_rows", "attr2", F.col("value2").alias("implied")
    )
    others = strong.join(_single(singles, 2), "attr2").filter(F.col("value2") != F.col("implied"))
    seen = others.join(pairs, ["attr1", "value1", "attr2", "value2"], "left").fillna({"n_pair": 0})
    rare = seen.filter(
        F.col("n_pair") * F.col("n_rows") / (F.col("n_value1") * F.col("n_value2")) <= 1 - F.lit(epsilon)
    )
    return rare.select("attr1", "value1", "attr2", "value2", "n_pair").distinct()


def low_lift_pairs(df: DataFrame, attrs: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Seen value pairs that are rare beside the rarer of their values; nulls are ignored."""
    pairs, singles = _counts(df, attrs)
    rated = pairs.join(_single(singles, 1), ["attr1", "value1"]).join(_single(singles, 2), ["attr2", "value2"])
    lift = F.col("n_pair") / F.least("n_value1", "n_value2")
    return rated.withColumn("lift", lift).filter(F.col("lift") < threshold).select(
        "attr1", "value1", "attr2", "value2", "n_pair", "lift"
    )


def rare_orderings(df: DataFrame, attrs: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """For each pair of numeric attributes the orderings (<, =, >) that few rows show."""
    pairs = list(combinations(attrs, 2))
    tests = {"<": lambda x, y: x < y, "=": lambda x, y: x == y, ">": lambda x, y: x > y}
    counters, rows = [], []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        counters.append(F.count_if(both).alias(f"all_{i}"))
        for j, (sign, test) in enumerate(tests.items()):
            counters.append(F.count_if(test(F.col(a), F.col(b))).alias(f"n_{i}_{j}"))
            rows.append(
                F.struct(
                    F.lit(a).alias("attr1"),
                    F.lit(sign).alias("ordering"),
                    F.lit(b).alias("attr2"),
                    F.col(f"n_{i}_{j}").alias("n_rows"),
                    (F.col(f"n_{i}_{j}") / F.nullif(F.col(f"all_{i}"), F.lit(0))).alias("share"),
                )
            )
    return df.agg(*counters).select(F.inline(F.array(*rows))).filter(F.col("share") < threshold)


def _typed(schema: StructType, attr: str, value: str) -> int | float | str:
    kind = schema[attr].dataType
    return int(value) if isinstance(kind, IntegralType) else float(value) if isinstance(kind, NumericType) else value


def as_edit_rules(pairs: DataFrame, schema: StructType) -> list[EditRule]:
    """Mined pairs as rules, with values in the types of the mined table. A rule list is driver-side data."""
    rows = pairs.select("attr1", "value1", "attr2", "value2").collect()
    return [EditRule(tuple((r[a], _typed(schema, r[a], r[v])) for a, v in (("attr1", "value1"), ("attr2", "value2")))) for r in rows]


def as_implications(found: DataFrame, schema: StructType) -> list[Implication]:
    """Mined implications as rules, as few as there are strong implications."""
    rows = found.select("attr1", "value1", "attr2", "value2").orderBy("attr1", "value1", "attr2", "value2").collect()
    return [Implication(*((r[a], _typed(schema, r[a], r[v])) for a, v in (("attr1", "value1"), ("attr2", "value2")))) for r in rows]


def zscores(df: DataFrame, keys: Sequence[str], attrs: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Cells further than ``limit`` standard deviations from their attribute's mean."""
    stats = df.agg(F.struct(*[F.avg(a).alias(f"m_{a}") for a in attrs], *[F.stddev(a).alias(f"s_{a}") for a in attrs]))
    out = df.select(*keys, *attrs).withColumn("_stats", stats.scalar())
    cells = [
        F.struct(
            F.lit(a).alias("attr"),
            F.col(a).cast("double").alias("value"),
            ((F.col(a) - F.col(f"_stats.m_{a}")) / F.nullif(F.col(f"_stats.s_{a}"), F.lit(0.0))).alias("z"),
        )
        for a in attrs
    ]
    return out.select(*keys, F.inline(F.array(*cells))).filter(F.abs("z") > limit)


# --- isolation forest -----------------------------------------------------------------------

_NODES = "tree int, node int, attr int, cut double, left int, right int, size long"


def _grow(rows: np.ndarray, tree: int, seed: int) -> list[tuple]:
    """One isolation tree over a sample, as rows of a node table; integer cuts."""
    rng = np.random.default_rng([seed, tree])
    deepest = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list[list] = []
    todo = [(rows, 0, None, None)]
    while todo:
        part, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, len(part)])
        if parent is not None:
            nodes[parent][side] = me
        low, high = part.min(axis=0), part.max(axis=0)
        open_attrs = np.flatnonzero(high > low)
        if depth >= deepest or len(part) <= 1 or not len(open_attrs):
            continue
        attr = int(rng.choice(open_attrs))
        cut = float(rng.integers(int(np.floor(low[attr])), int(np.ceil(high[attr]))))
        goes_left = part[:, attr] <= max(cut, low[attr])
        nodes[me][2:4] = [attr, max(cut, float(low[attr]))]
        todo.append((part[goes_left], depth + 1, me, 4))
        todo.append((part[~goes_left], depth + 1, me, 5))
    return [tuple(n) for n in nodes]


def _path_correction(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    out[big] = 2 * (np.log(n[big] - 1) + np.euler_gamma) - 2 * (n[big] - 1) / n[big]
    return out


def smallest_hashes(df: DataFrame, key: Sequence[str], rows: int, seed: int = 0) -> DataFrame:
    """The ``rows`` rows whose keys have the smallest hashes: a draw that does not depend on files, partitions or order.

    The hash is the MD5 sum of seed and key; rows with equal keys are drawn together, in no set order if the last place falls among them. About
    twice as many rows as wanted pass a first sieve, so a task hands on few. Adds ``_hash``.
    """
    cells = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), *cells).cast("binary")))
    share = min(1.0, 2 * rows / max(1, df.count()))
    first = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    sieved = hashed.where(first <= share)
    if share < 1 and sieved.limit(rows).count() < rows:
        sieved = hashed
    return sieved.orderBy("_hash").limit(rows)


def isolation_forest(
    df: DataFrame, attrs: Sequence[str], trees: int = 100, sample: int = 256, threshold: float | None = 0.6, seed: int = 0,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Rows with an isolation ``score`` (above ``threshold`` unless that is None).

    trees * sample rows are drawn by hashes of their ``key`` (all columns without one) and dealt to the trees; a smaller table is dealt round by
    round. So the same rows give the same forest, however they are stored. The forest has at most
    2 * trees * sample nodes however large the table is, so it is shipped to the executors, which
    score their batches with it.
    """
    spark, names = df.sparkSession, list(attrs)
    drawn = smallest_hashes(df.dropna(subset=names), list(key or df.columns), trees * sample, seed)
    drawn = cut_lineage(drawn.select("_hash", *[F.col(a).cast("double").alias(a) for a in names]))
    n_drawn = drawn.count()
    if n_drawn == 0:
        return df.withColumn("score", F.lit(None).cast("double")).filter(F.lit(False))
    size = min(sample, n_drawn)
    rounds = -(-trees * size // n_drawn)
    # Each round deals all drawn rows, in another order; a draw is bounded, so its places are counted in one task.
    copies = drawn.select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_round"))
    order = Window.partitionBy(F.lit(0)).orderBy("_round", F.md5(F.concat("_hash", F.col("_round").cast("string")).cast("binary")), *names)
    dealt = copies.withColumn("_place", F.row_number().over(order) - 1).where(F.col("_place") < trees * size)
    dealt = dealt.withColumn("tree", F.floor(F.col("_place") / size).cast("int"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf[names].to_numpy()
        rows = rows[np.lexsort(rows.T[::-1])]
        columns = ["tree", "node", "attr", "cut", "left", "right", "size"]
        return pd.DataFrame(_grow(rows, tree, seed), columns=columns)

    nodes = dealt.groupBy("tree").applyInPandas(grow, _NODES).orderBy("tree", "node").toPandas()
    forest = spark.sparkContext.broadcast(
        [g.drop(columns=["tree"]).to_numpy(dtype=float) for _, g in nodes.groupby("tree")]
    )
    scale = float(_path_correction(np.array([size]))[0]) or 1.0

    def score(batches):
        for pdf in batches:
            points = pdf[names].to_numpy(dtype=float)
            known = ~np.isnan(points).any(axis=1)
            total = np.zeros(len(points))
            for table in forest.value:
                at = np.zeros(len(points), dtype=int)
                depth = np.zeros(len(points))
                while True:
                    inner = known & (table[at, 1] >= 0)
                    if not inner.any():
                        break
                    here = at[inner]
                    values = points[inner, table[here, 1].astype(int)]
                    at[inner] = np.where(values <= table[here, 2], table[here, 3], table[here, 4]).astype(int)
                    depth[inner] += 1
                total += depth + _path_correction(table[at, 5])
            result = np.where(known, 2.0 ** (-total / len(forest.value) / scale), np.nan)
            yield pdf.assign(score=pd.Series(result, index=pdf.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", score double"
    scored = df.mapInPandas(score, schema).withColumn("score", F.nanvl("score", F.lit(None)))
    return scored if threshold is None else scored.filter(F.col("score") > threshold)
