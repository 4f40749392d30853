"""Text features as tables: one row per (text, term)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemend.functions.text import ENGLISH_STOP_WORDS, content_words
from tablemend.operators.joins import join_per_key

TASK_BYTES = 8 << 20  # of text whose words a task counts


def term_counts(df: DataFrame, key: str, text: str, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Bag of words: how often each content word occurs in each text.

    Texts are shuffled by their key before they are split, and their words are counted there: no token is shuffled. A task
    counts about `TASK_BYTES` of text, however large the table is; adaptive execution would go by the compressed texts.
    """
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    words = content_words(F.col(text), stop_words)
    return (
        df.select(key, text)
        .repartition(tasks, key)
        .select(key, F.explode(words).alias("term"))
        .groupBy(key, "term")
        .agg(F.count("*").alias("n"))
    )


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def tf_idf(df: DataFrame, key: str, text: str, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Term weights n * (ln((1 + texts) / (1 + df)) + 1), scaled to length 1 per text.

    The join on the term is against one row per term: adaptive execution broadcasts it while it is
    small and otherwise splits terms that occur in most texts.
    """
    counts = term_counts(df, key, text, stop_words)
    texts = df.agg(F.count("*")).scalar()
    frequencies = document_frequencies(counts).withColumn("idf", F.log((1 + texts) / (1 + F.col("df"))) + 1)
    weighted = join_per_key(counts, frequencies.select("term", "idf"), ["term"], "inner")
    weighted = weighted.withColumn("raw", F.col("n") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("raw") / length).alias("weight"))
