"""A training corpus in five stages: toxicity, repeated lines, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns documents; the last one
returns them with their tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.llm import bpe, decontam, lines, simhash, toxicity
from tablemend.llm.common import stored, table
from tablemend.llm.graph import connected_components
from tablemend.operators.joins import join_per_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7. Learnt from all labels of the documents at hand; without labels all stay."""
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.train(docs.select("doc_id", "text"), "text", "toxic", labels, "doc_id")
    scored = toxicity.score(docs.select(*COLUMNS), "text", model, threshold=0.7)
    return scored.where("predicted = 0").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which nothing is left are copies, and go. ``n_chars`` is counted anew."""
    done = lines.without_repeats(docs.select(*COLUMNS), "doc_id", "text").where("NOT emptied")
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, then text.

    Near duplicates are texts that `simhash.components` links (fingerprints of three-word shingles at two bits, all pairs by the tree of
    vantage points) or that are similar (five words, 0.8); groups are connected through links of both kinds.
    A null id comes last. Documents without words are one group. Of rows repeated whole one stays.
    """
    docs = docs.select(*COLUMNS)
    order = F.xxhash64("doc_id", "text")
    keyed = docs.select("doc_id", "text", order.alias("row")).dropDuplicates(["row"])
    similar = stored(simhash.similar_groups(keyed, "row", "text", shingle=5, similarity=0.8), "groups")
    printed = simhash.components(docs.select("text", order.alias("row")), "row", "text", shingle=3, radius=2)
    named = connected_components(similar.unionAll(printed.select("row", "component")), "row", "least").withColumnRenamed("node", "row")
    groups = join_per_key(similar.select("row"), named, ["row"]).select("row", F.coalesce("component", "row").alias("least"))
    ids = docs.select("doc_id", order.alias("row")).distinct()
    ranked = join_per_key(ids, groups, ["row"], "inner")
    kept = ranked.groupBy("least").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("k")).select(F.col("k.row").alias("row"))
    kept = join_per_key(docs.withColumn("row", order), kept, ["row"], "left_semi")
    return kept.dropDuplicates(["row"]).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. A row is told by id and text, so rows that share an id are judged apart."""
    docs = docs.select(*COLUMNS).withColumn("row", F.xxhash64("doc_id", "text"))
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), "row", "text", "item_id", "text")
    return join_per_key(docs, found.select("row").distinct(), ["row"], "left_anti").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether the ids decode to the text again."""
    coded = bpe.encode(docs.select(*COLUMNS), "text", bpe.public_vocabulary(), "ids", round_trip="round_trip")
    return coded.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", token_stage),
]
#: Learnt scores, similarity of fingerprints and merges of tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
