"""Readers and writers, each checked by writing a given table and reading it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemend.catalog.base import (
    ALL_SQL,
    GATED,
    LINES_SQL,
    NOTES_SQL,
    ROW,
    ROWS,
    counters_sql,
    lines,
    notes,
    quality_sql,
    query,
    repaired,
    table,
)
from tablemend.catalog.evaluation import PREFIX_SQL, SWEEP_SQL, prefixes, sweep
from tablemend.operators.aggregates import unfolded
from tablemend.operators.evaluate import cell_counts, with_quality
from tablemend.operators.joins import match_three
from tablemend.session import scratch_path
from tablemend.sources import metrics, tables

SYMBOLS_SQL = """CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL
  ELSE o_orderpriority END"""


def _with_symbols(spark, sf):
    turn = F.col("o_orderkey") % 5
    symbol = F.when(turn == 0, "").when(turn == 1, "?").when(turn == 2, "[]").when(turn == 3, "-")
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(symbol, F.col("o_orderpriority")).alias("priority"))


@query(
    "csv_scan_null_symbols",
    f"SELECT o_orderkey::VARCHAR AS o_orderkey, {SYMBOLS_SQL} AS priority FROM orders",
)
def _(spark, sf):
    path = scratch_path(spark, "symbols")
    tables.write_csv(_with_symbols(spark, sf), path, sep=";")
    return tables.read_csv(spark, path, sep=";", escaped=True)


@query("csv_documents_round_trip", "SELECT doc_id::VARCHAR AS doc_id, text, source FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "documents")
    tables.write_csv(table(spark, sf, "documents").select("doc_id", "text", "source"), path)
    return tables.read_csv(spark, path, symbols=(), escaped=True)


@query("csv_foreign_documents", "SELECT doc_id::VARCHAR AS doc_id, text, source FROM documents")
def _(spark, sf):
    """Written by another writer, with plain line breaks in quoted cells; read in several tasks."""
    path = scratch_path(spark, "foreign")
    foreign = table(spark, sf, "documents").select("doc_id", "text", "source")
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    foreign.write.options(**options).csv(path)
    return tables.read_csv(spark, path, symbols=())


@query(
    "csv_inferred_types",
    """SELECT o_orderpriority, sum(o_orderkey)::BIGINT AS keys, max(o_totalprice) AS top FROM orders GROUP BY o_orderpriority""",
)
def _(spark, sf):
    path = scratch_path(spark, "inferred")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    tables.write_csv(orders, path)
    typed = tables.read_csv(spark, path, schema=tables.inferred_schema(spark, path, escaped=True), escaped=True)
    return typed.groupBy("o_orderpriority").agg(F.sum("o_orderkey").alias("keys"), F.max("o_totalprice").alias("top"))


@query(
    "csv_types_of_late_values",
    """SELECT column_name, column_type FROM (VALUES ('o_orderkey', 'int'), ('late', 'double'), ('marked', 'int'), ('mixed', 'string'))
    AS t(column_name, column_type)
    WHERE (SELECT count(*) FROM orders WHERE o_orderkey > 1200) > 0""",
)
def _(spark, sf):
    """Decimals and words that come late in a file, and a null symbol among numbers, decide types."""
    path = scratch_path(spark, "late")
    late = F.col("o_orderkey") > 1200
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(late, F.lit("0.5")).otherwise(F.col("o_orderkey").cast("string")).alias("late"),
        F.when(F.col("o_orderkey") % 7 == 3, F.lit("?")).otherwise(F.col("o_orderkey").cast("string")).alias("marked"),
        F.when(late, F.lit("high")).otherwise(F.lit("1")).alias("mixed"),
    )
    tables.write_csv(orders.orderBy("o_orderkey"), path)
    schema = tables.inferred_schema(spark, path, escaped=True)
    rows = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    return spark.createDataFrame(rows, "column_name string, column_type string")


CONTRACT = {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderpriority": "int"}


@query(
    "contracted_read",
    "SELECT o_orderkey, o_totalprice, NULL::INTEGER AS o_orderpriority, o_orderstatus FROM orders",
)
def _(spark, sf):
    path = scratch_path(spark, "contract")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    tables.write_csv(orders, path)
    return tables.apply_contract(tables.read_csv(spark, path, escaped=True), CONTRACT)


@query(
    "failed_casts",
    """SELECT 'o_orderkey' AS attr, 0::BIGINT AS n_failed UNION ALL SELECT 'o_totalprice', 0
    UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE try_cast(o_orderpriority AS INTEGER) IS NULL) FROM orders""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(*[F.col(c).cast("string").alias(c) for c in CONTRACT])
    return tables.failed_casts(orders, CONTRACT)


@query("csv_write_round_trip", f"WITH {LINES_SQL} SELECT {ROWS}, flag, level, l_returnflag || '; \"x\"' AS noted FROM lines")
def _(spark, sf):
    rows = lines(spark, sf).select(*ROW, "flag", "level", F.concat("l_returnflag", F.lit('; "x"')).alias("noted"))
    path = tables.write_csv(rows, scratch_path(spark, "lines") + ".csv", sep=";", null_symbol="?", suffix="_copy")
    back = tables.read_csv(spark, path, sep=";", escaped=True)
    contract = {f.name: f.dataType for f in rows.schema.fields if f.dataType.typeName() != "string"}
    return tables.apply_contract(back, contract)


@query("csv_chunks_as_one_table", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def _(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    paths = []
    for segments in (["BUILDING", "AUTOMOBILE"], ["MACHINERY"], None):
        inside = F.col("c_mktsegment").isin(segments) if segments else ~F.col("c_mktsegment").isin(
            "BUILDING", "AUTOMOBILE", "MACHINERY"
        )
        paths.append(tables.write_csv(customers.filter(inside), scratch_path(spark, "chunk")))
    read = tables.read_csv(spark, paths, escaped=True)
    return tables.apply_contract(read, {"c_custkey": "bigint", "c_nationkey": "int"})


@query(
    "metrics_upsert",
    """WITH m AS (SELECT o_orderstatus AS dataset, o_orderpriority AS strategy, count(*) AS errors FROM orders GROUP BY 1, 2)
    SELECT dataset, strategy, CASE WHEN dataset = 'F' THEN errors + 1 ELSE errors END AS errors FROM m""",
)
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    counts = table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("strategy")
    ).agg(F.count("*").alias("errors"))
    metrics.upsert_metrics(counts, path, ["dataset", "strategy"])
    again = counts.filter("dataset = 'F'").withColumn("errors", F.col("errors") + 1)
    metrics.upsert_metrics(again, path, ["dataset", "strategy"])
    return metrics.read_metrics(spark, path).select("dataset", "strategy", "errors")


@query(
    "metrics_upsert_by_label",
    """WITH m AS (SELECT '00' || (o_orderkey % 3) AS dataset, o_orderpriority AS strategy, o_orderstatus AS attr, count(*) AS errors
      FROM orders GROUP BY ALL)
    SELECT dataset, strategy, attr, CASE WHEN attr = 'F' AND dataset = '001' THEN errors + 1 ELSE errors END AS errors FROM m""",
)
def _(spark, sf):
    """Labels of one partition written one after another; the keys of partitions look like numbers."""
    path = scratch_path(spark, "metrics")
    keys = [F.concat(F.lit("00"), (F.col("o_orderkey") % 3).cast("string")).alias("dataset"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderstatus").alias("attr")]
    counts = table(spark, sf, "orders").groupBy(*keys).agg(F.count("*").alias("errors"))
    for part in (counts.filter("attr = 'O'"), counts.filter("attr <> 'O'"), counts.filter("attr = 'F' AND dataset = '001'").withColumn("errors", F.col("errors") + 1)):
        metrics.upsert_metrics(part, path, ["dataset", "strategy"], ["attr"])
    return metrics.read_metrics(spark, path, counts.schema)


@query(
    "metrics_before_and_after",
    """WITH m AS (SELECT o_orderstatus AS dataset, o_orderpriority AS strategy, count(*) AS errors FROM orders GROUP BY ALL)
    SELECT dataset, strategy, errors, CASE WHEN dataset = 'F' THEN errors * 2 ELSE errors END AS errors_after FROM m""",
)
def _(spark, sf):
    """A version that a reader has opened stays whole while a writer replaces some of its partitions."""
    path = scratch_path(spark, "metrics")
    keys = [F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("strategy")]
    counts = table(spark, sf, "orders").groupBy(*keys).agg(F.count("*").alias("errors"))
    metrics.upsert_metrics(counts, path, ["dataset", "strategy"])
    before = metrics.read_metrics(spark, path, counts.schema)
    metrics.upsert_metrics(before.filter("dataset = 'F'").withColumn("errors", F.col("errors") * 2), path, ["dataset", "strategy"])
    after = metrics.read_metrics(spark, path, counts.schema).withColumnRenamed("errors", "errors_after")
    return before.join(after, ["dataset", "strategy"], "full")


@query(
    "sweep_from_nested_documents",
    f"{SWEEP_SQL} SELECT attr, NULL::DOUBLE AS tau, threshold, errors, repairs, correct FROM rated",
)
def _(spark, sf):
    path = scratch_path(spark, "sweep")
    metrics.sweep_documents(sweep(spark, sf)).write.text(path)
    return metrics.flatten_sweep(metrics.documents(spark, path))


@query("prefixes_from_nested_documents", PREFIX_SQL)
def _(spark, sf):
    path = scratch_path(spark, "prefixes")
    metrics.prefix_documents(prefixes(spark, sf)).write.text(path)
    return metrics.flatten_prefixes(metrics.documents(spark, path))


@query(
    "training_records_from_nested_documents",
    f"""WITH {NOTES_SQL}, long AS (SELECT source AS strategy, 'quality' AS attr, quality AS c FROM notes
        UNION ALL SELECT source, 'toxic', toxic FROM notes),
      n AS (SELECT strategy, attr, c, count(*) AS n FROM long WHERE c IS NOT NULL AND strategy IS NOT NULL GROUP BY ALL)
    SELECT strategy, 'prior' AS model, attr, min(n) / max(n) AS ir, NULL::DOUBLE AS duration, max(n) / sum(n) AS proba
    FROM n GROUP BY strategy, attr""",
)
def _(spark, sf):
    """Imbalance of the labels of every source, and how sure a guess of the commonest class is."""
    path, labels = scratch_path(spark, "training"), ["quality", "toxic"]
    long = unfolded(notes(spark, sf), ["source"], labels, c="{}").filter("c IS NOT NULL AND source IS NOT NULL")
    counts = long.groupBy(F.col("source").alias("strategy"), "attr", "c").agg(F.count("*").alias("n"))
    records = counts.groupBy("strategy", F.lit("prior").alias("model"), "attr").agg(
        (F.min("n") / F.max("n")).alias("ir"), F.lit(None).cast("double").alias("duration"), (F.max("n") / F.sum("n")).alias("proba")
    )
    metrics.training_documents(records).write.text(path)
    return metrics.flatten_training(metrics.documents(spark, path))


@query(
    "strategies_from_nested_documents",
    ALL_SQL + " UNION ALL ".join(f" SELECT 'gate of {a}' AS strategy, {counters_sql(a, a, a + '_gs', a + '_rep')} FROM repaired" for a in GATED),
)
def _(spark, sf):
    path = scratch_path(spark, "strategies")
    rated = with_quality(cell_counts(repaired(spark, sf), GATED)).withColumn("strategy", F.concat(F.lit("gate of "), "attr"))
    metrics.strategy_documents(rated).write.text(path)
    return metrics.flatten_strategies(metrics.documents(spark, path))


@query(
    "external_cleaner_output",
    f"""WITH {LINES_SQL}, u AS (SELECT l_orderkey, l_linenumber, any_value(finished) AS finished, any_value(returned) AS gs,
        CASE WHEN any_value(cheap) = 1 THEN any_value(returned) ELSE any_value(finished) END AS rep, count(*) AS n
        FROM lines GROUP BY 1, 2),
      k AS (SELECT 'finished' AS attr, count(*) FILTER (WHERE finished IS DISTINCT FROM gs) AS errors,
        count(*) FILTER (WHERE finished IS DISTINCT FROM rep) AS repairs,
        count(*) FILTER (WHERE finished IS DISTINCT FROM rep AND rep IS NOT DISTINCT FROM gs) AS correct FROM u WHERE n = 1)
    """ + quality_sql("k", "attr"),
)
def _(spark, sf):
    key = ["l_orderkey", "l_linenumber"]
    rows = lines(spark, sf)
    path = scratch_path(spark, "cleaner")
    outside = F.when(F.col("cheap") == 1, F.col("returned")).otherwise(F.col("finished"))
    tables.write_csv(rows.select(*key, F.coalesce(outside.cast("string"), F.lit("A Null Cell")).alias("finished")), path)
    read = tables.read_csv(spark, path, symbols=("", "A Null Cell"))
    read = tables.apply_contract(read, {"l_orderkey": "bigint", "l_linenumber": "int", "finished": "int"})
    standard = rows.select(*key, F.col("returned").alias("finished"))
    matched = match_three(rows, standard, read, key, ["finished"]).filter("match_status = 'ok'")
    return with_quality(cell_counts(matched, ["finished"]))
