"""Naive Bayes as a relation: one row per term with its counts in every class of every attribute.

Learning is one grouping of the words by term; predicting is a join of the words with that table and a sum per text. No vocabulary exists
anywhere else: not in a model object, not on the driver, not in a broadcast of unknown size (the frequent terms that are broadcast are a bounded number). Weights are whole numbers (millionths of a
logarithm), so sums do not depend on their order.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.operators.joins import join_per_key
from tablemend.session import stored

SCALE = 1_000_000
FREQUENT = 2**20  # terms at most that are broadcast: those with at least one in so many of the words learned from


@dataclass(frozen=True)
class TermModel:
    """``table``: term and one weight for each attribute and class (``w0``, ``w1``, ...); 0 where no text of the attribute has the term.

    ``frequent`` in it marks terms that make up one in `FREQUENT` of the words or more, so there are at most so many of them. ``classes`` and ``priors`` (in millionths) are by attribute, in the order of the weights.
    """

    table: DataFrame
    classes: Mapping[str, tuple[int, ...]]
    priors: Mapping[str, tuple[int, ...]]

    def places(self, attr: str) -> range:
        """The numbers of the weights of an attribute."""
        start = 0
        for a, classes in self.classes.items():
            if a == attr:
                return range(start, start + len(classes))
            start += len(classes)
        raise KeyError(attr)

    def of(self, attr: str) -> TermClassifier:
        self.places(attr)
        return TermClassifier(self, attr)


@dataclass(frozen=True)
class TermClassifier:
    """One attribute of a model."""

    model: TermModel
    attr: str


def fit_terms(rows: DataFrame, classes: Mapping[str, Sequence[int]], smoothing: float, weighted: bool = True) -> TermModel:
    """A model from ``rows`` (words, attr, class): multinomial naive Bayes for all attributes at once.

    ``weighted``: classes count alike, however many rows they have. Rows of other attributes or classes, and null words, are left out. A class without
    rows keeps its smoothed prior. Words are added up before they are shuffled, so a frequent word is a row per task.
    """
    cells = [(a, c) for a, own in classes.items() for c in own]
    counted = rows.select(F.explode("words").alias("term"), "attr", "class").groupBy("term").agg(
        *[F.count_if((F.col("attr") == a) & (F.col("class") == c)).alias(f"n{i}") for i, (a, c) in enumerate(cells)]
    )
    counted = stored(counted, "terms")
    texts = {(r["attr"], r["class"]): r["n"] for r in rows.groupBy("attr", "class").agg(F.count("*").alias("n")).collect()}
    own = {a: [i for i, (b, _) in enumerate(cells) if a == b] for a in classes}
    seen = {a: sum((F.col(f"n{i}") for i in at), F.lit(0)) > 0 for a, at in own.items()}
    sums = counted.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(cells))], *[F.count_if(s).alias(f"terms_{a}") for a, s in seen.items()]).first()
    weights, priors = [], {}
    for a, at in own.items():
        n = [texts.get(cells[i], 0) for i in at]
        there = sum(x > 0 for x in n)
        # The same weight for all rows of a class, so it can wait until the counts are known.
        share = [sum(n) / (there * x) if weighted and x else 1.0 for x in n]
        everything = sum(w * x for w, x in zip(share, n))
        priors[a] = tuple(math.floor(SCALE * math.log((w * x + smoothing) / (everything + smoothing * len(n)))) for w, x in zip(share, n))
        for i, w in zip(at, share):
            below = w * (sums[f"n{i}"] or 0) + smoothing * sums[f"terms_{a}"]
            weight = F.floor(F.lit(float(SCALE)) * F.log((F.lit(w) * F.col(f"n{i}") + F.lit(smoothing)) / F.lit(below or 1.0)))
            weights.append(F.when(seen[a], weight).otherwise(F.lit(0)).cast("long").alias(f"w{i}"))
    total = sum(sums[f"n{i}"] or 0 for i in range(len(cells)))
    frequent = sum((F.col(f"n{i}") for i in range(len(cells))), F.lit(0)) * F.lit(FREQUENT) >= F.lit(max(total, 1))
    return TermModel(counted.select("term", *weights, frequent.alias("frequent")), {a: tuple(c) for a, c in classes.items()}, priors)


def term_scores(model: TermModel, df: DataFrame, words: Column, text: str) -> DataFrame:
    """``df`` with ``_w0``, ``_w1``, ...: the summed weights of each row's words, for each attribute and class.

    Frequent terms are broadcast and added up where the texts are read; only words without one are shuffled, to the terms' table. A null beside the
    words of each text counts equal texts, which share their sums. Null texts, and texts without known words, have zeros.
    """
    names = [f"w{i}" for i in range(sum(map(len, model.classes.values())))]
    digest = F.unhex(F.md5(F.col(text)))
    with_mark = F.concat(F.array(F.lit(None).cast("string")), F.array_compact("_own"))
    rows = df.select(digest.alias("_digest"), words.alias("_own")).where("_digest IS NOT NULL")
    tokens = rows.select("_digest", F.explode(with_mark).alias("term"))
    known = model.table.where("frequent").select("term", "frequent", *[F.col(w).alias(f"_{w}") for w in names])
    found = tokens.join(F.broadcast(known), "term", "left").withColumn("_rare", F.when(F.col("frequent").isNull(), F.col("term")))
    added = found.groupBy("_digest", "_rare").agg(
        F.count("*").alias("_n"), F.count_if(F.col("term").isNull()).alias("_texts"), *[F.sum(f"_{w}").alias(f"_{w}") for w in names]
    )
    # The sums of frequent terms match no term; a key of their own keeps them spread.
    own = F.coalesce("_rare", F.concat(F.lit("\0"), F.hex("_digest")))
    joined = join_per_key(added.select("*", own.alias("term")), model.table.where("NOT frequent").drop("frequent"), ["term"])
    sums = joined.groupBy("_digest").agg(
        F.max("_texts").alias("_texts"),
        *[F.sum(F.coalesce(F.col(f"_{w}"), F.lit(0)) + F.coalesce(F.col("_n") * F.col(w), F.lit(0))).alias(f"_{w}") for w in names],
    )
    sums = sums.select("_digest", *[F.expr(f"_{w} div _texts").alias(f"_{w}") for w in names])
    out = join_per_key(df.withColumn("_digest", digest), sums, ["_digest"], "left")
    return out.select(*df.columns, *[F.coalesce(F.col(f"_{w}"), F.lit(0)).alias(f"_{w}") for w in names])


def class_scores(model: TermModel, attr: str) -> list[Column]:
    """Scores of an attribute's classes (millionths) from the summed weights."""
    return [F.col(f"_w{i}") + F.lit(p) for i, p in zip(model.places(attr), model.priors[attr])]


def probabilities(scores: Sequence[Column]) -> Column:
    """Shares that add up to 1, from scores in millionths."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    shares = F.array(*[F.exp((s - top) / F.lit(float(SCALE))) for s in scores])
    total = F.aggregate(shares, F.lit(0.0), lambda x, y: x + y)
    return F.transform(shares, lambda s: s / total)


def likeliest(model: TermModel, attr: str) -> tuple[Column, Column]:
    """Class and probability; the first class wins ties."""
    scores = class_scores(model, attr)
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    chosen = F.coalesce(*[F.when(s == top, F.lit(i)) for i, s in enumerate(scores)])
    return chosen, F.array_max(probabilities(scores))


# --- storage -------------------------------------------------------------------------------------


def save_terms(one: TermClassifier, path: str) -> None:
    """The weights as a table and, beside it, one row that describes them; written last, so a half-written model is no model."""
    model, spark = one.model, one.model.table.sparkSession
    model.table.write.mode("overwrite").parquet(f"{path}/terms")
    told = {"attr": one.attr, "classes": model.classes, "priors": model.priors}
    spark.createDataFrame([(json.dumps(told),)], "model string").write.mode("overwrite").parquet(f"{path}/metadata")


def load_terms(spark: SparkSession, path: str) -> TermClassifier:
    told = json.loads(spark.read.parquet(f"{path}/metadata").first()["model"])
    classes, priors = ({a: tuple(v) for a, v in told[k].items()} for k in ("classes", "priors"))
    table = spark.read.parquet(f"{path}/terms")
    if "frequent" not in table.columns:  # stored before terms were marked
        table = table.withColumn("frequent", F.lit(False))
    return TermModel(table, classes, priors).of(told["attr"])
