"""Metrics tables: keyed upsert, and reading of nested result documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemend.session import cut_lineage
from tablemend.sources.versions import State, newest, publish, read_state, write_version

SWEEP_RECORD = (
    "map<string, struct<errors: bigint, avg_proba: double, threshold: array<double>, repairs: array<bigint>, "
    "correct_repairs: array<bigint>, precision: array<double>, recall: array<double>, `F-1`: array<double>>>"
)
PREFIX_RECORD = "map<string, map<string, struct<correct_repairs: bigint, repairs: bigint, errors: bigint>>>"
TRAINING_RECORD = "map<string, map<string, map<string, struct<ir: double, duration: double, proba: double>>>>"
STRATEGY_RECORD = (
    "struct<`repair methods`: array<struct<key: string, `repair method`: string, `Number of errors`: bigint, "
    "`Number of repairs`: bigint, `Number of correct repairs`: bigint, `Precision`: double, `Recall`: double, `F1`: double>>>"
)


def upsert_metrics(metrics: DataFrame, path: str, by: Sequence[str], keys: Sequence[str] = ()) -> None:
    """Replace the rows that share their full key (``by`` and ``keys``, nulls alike) with rows of ``metrics``; keep all others.

    ``by`` are the partitions (such as dataset and strategy), ``keys`` what tells rows apart within one (such as model and
    label). Only partitions that ``metrics`` touches are written again, as a new version beside the old files. Readers
    see the table before or after, and of two writers at a time neither loses rows: the later one starts again from what the
    other has left. The given columns and types are the table's.
    """
    spark, given = metrics.sparkSession, cut_lineage(metrics)
    while True:
        state, rows = newest(spark, path), given
        if state.versions:
            old = read_state(spark, path, state, metrics.schema)

            def same(columns):
                return [old[c].eqNullSafe(given[c]) for c in columns]

            touched = old.join(given.select(*by).distinct(), same(by), "left_semi")
            rows = given.unionByName(touched.join(given.select(*by, *keys), same([*by, *keys]), "left_anti"))
        versions = {**state.versions, **write_version(rows, path, by)}
        if publish(spark, path, State(state.number + 1, versions)):
            return


def read_metrics(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The newest version. With a schema, keys keep their type: without one, a partition named ``001`` is read as the number 1."""
    return read_state(spark, path, newest(spark, path), schema)


def write_documents(df: DataFrame, path: str) -> None:
    """Nested results as JSON, one document per row."""
    df.write.mode("errorifexists").json(path)


def documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Whole JSON documents as text, one row per file."""
    return spark.read.option("wholetext", True).text(paths if isinstance(paths, str) else list(paths))


def flatten_sweep(docs: DataFrame, text: str = "value") -> DataFrame:
    """label -> arrays by threshold, as one row per label and threshold."""
    entries = docs.select(F.explode(F.from_json(text, SWEEP_RECORD)).alias("attr", "r"))
    steps = F.arrays_zip(*[F.col(f"r.{c}").alias(c) for c in ("threshold", "repairs", "correct_repairs")])
    rows = entries.select("attr", F.col("r.errors").alias("errors"), F.col("r.avg_proba").alias("tau"), F.explode(steps).alias("s"))
    return rows.select(
        "attr", "tau", F.col("s.threshold").alias("threshold"), "errors",
        F.col("s.repairs").alias("repairs"), F.col("s.correct_repairs").alias("correct"),
    )


def flatten_prefixes(docs: DataFrame, text: str = "value") -> DataFrame:
    """source step -> number of attributes -> counters, as rows; steps start at 0, ranks at 1."""
    steps = docs.select(F.explode(F.from_json(text, PREFIX_RECORD)).alias("step", "by_attrs"))
    rows = steps.select("step", F.explode("by_attrs").alias("n_attrs", "c"))
    return rows.select(
        (F.col("step").cast("int") + 1).alias("source_rank"), F.col("n_attrs").cast("int").alias("n_attrs"),
        F.col("c.errors").alias("errors"), F.col("c.repairs").alias("repairs"), F.col("c.correct_repairs").alias("correct"),
    )


def flatten_training(docs: DataFrame, text: str = "value") -> DataFrame:
    """strategy -> model -> label -> training record, as rows."""
    out = docs.select(F.explode(F.from_json(text, TRAINING_RECORD)).alias("strategy", "by_model"))
    out = out.select("strategy", F.explode("by_model").alias("model", "by_label"))
    return out.select("strategy", "model", F.explode("by_label").alias("attr", "r")).select("strategy", "model", "attr", "r.*")


def flatten_strategies(docs: DataFrame, text: str = "value") -> DataFrame:
    rows = docs.select(F.inline(F.from_json(text, STRATEGY_RECORD)["repair methods"]))
    return rows.select(
        F.col("key").alias("strategy"), F.col("Number of errors").alias("errors"),
        F.col("Number of repairs").alias("repairs"), F.col("Number of correct repairs").alias("correct"),
    )


def sweep_documents(sweep: DataFrame, tau: Mapping[str, float] | None = None) -> DataFrame:
    """One JSON document holding a sweep, in the nested shape that `flatten_sweep` reads.

    The sweep is a results table: one row per attribute and threshold.
    """
    rows = F.array_sort(F.collect_list(F.struct("threshold", "repairs", "correct")))
    per_attr = sweep.groupBy("attr").agg(F.max("errors").alias("errors"), rows.alias("rows"))
    record = F.struct(
        F.col("errors"),
        F.col("rows.threshold").alias("threshold"),
        F.col("rows.repairs").alias("repairs"),
        F.col("rows.correct").alias("correct_repairs"),
    )
    entries = per_attr.select(F.struct("attr", record.alias("record")).alias("entry"))
    table = F.map_from_entries(F.collect_list("entry"))
    return entries.agg(F.to_json(table).alias("value"))


def _nested(rows: DataFrame, keys: Sequence[str], record: Column) -> DataFrame:
    """One JSON document: a map by the first key of maps by the next, down to the record. A repeated key fails."""
    out = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], record.alias("_record"))
    for i in reversed(range(len(keys))):
        entry = F.struct(F.col(keys[i]), F.col("_record"))
        out = out.groupBy(*keys[:i]).agg(F.map_from_entries(F.collect_list(entry)).alias("_record"))
    return out.select(F.to_json("_record").alias("value"))


def prefix_documents(prefixes: DataFrame) -> DataFrame:
    """Counters by source prefix and number of attributes (a results table) in the shape that `flatten_prefixes` reads."""
    steps = prefixes.withColumn("source_rank", F.col("source_rank") - 1)
    return _nested(steps, ["source_rank", "n_attrs"], F.struct(F.col("correct").alias("correct_repairs"), "repairs", "errors"))


def training_documents(records: DataFrame) -> DataFrame:
    """Training records (a results table) in the shape that `flatten_training` reads; a missing measure is left out."""
    return _nested(records, ["strategy", "model", "attr"], F.struct("ir", "duration", "proba"))


def strategy_documents(rated: DataFrame) -> DataFrame:
    """Counters and quality by strategy (a results table) in the shape that `flatten_strategies` reads."""
    record = F.struct(
        F.col("strategy").alias("key"), F.col("strategy").alias("repair method"), F.col("errors").alias("Number of errors"),
        F.col("repairs").alias("Number of repairs"), F.col("correct").alias("Number of correct repairs"),
        F.col("precision").alias("Precision"), F.col("recall").alias("Recall"), F.col("f1").alias("F1"),
    )
    methods = F.array_sort(F.collect_list(record)).alias("repair methods")
    return rated.agg(methods).select(F.to_json(F.struct("repair methods")).alias("value"))
